"""Resampling, alignment and slicing of hourly series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattline.config import MARKET_TZ, TS, ZONE
from wattline.functions.calendar import day_of_week, local_time, utc_floor
from wattline.functions.numbers import row_sum
from wattline.plans.blocks import edge_rows

SERIES = "series"

SPAN_HOURS = 1024

# Fixed value: series whose name contains this are prices.
PRICE_MARK = "eur"


def hour_spine(bounds: DataFrame, keys: Sequence[str], first: str, last: str, ts: str = TS) -> DataFrame:
    """Every hour from ``first``, in steps of one hour, up to ``last`` per key.

    The few bounds would be expanded in one task. They are cut into spans first;
    the spans are spread over all shuffle partitions (a fixed number, which AQE
    does not merge) and expanded to hours there.
    """
    spans = F.sequence(F.col(first), F.col(last), F.expr(f"interval {SPAN_HOURS} hours"))
    hours = F.sequence(
        F.col("_span"), F.col("_span") + F.expr(f"interval {SPAN_HOURS - 1} hours"), F.expr("interval 1 hour")
    )
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        bounds.select(*keys, last, F.explode(spans).alias("_span"))
        .repartition(tasks, *keys, "_span")
        .select(*keys, last, F.explode(hours).alias(ts))
        .filter(F.col(ts) <= F.col(last))
        .select(*keys, ts)
    )


def missing_hours(
    bounds: DataFrame, hourly: DataFrame, keys: Sequence[str], first: str, last: str, ts: str = TS
) -> DataFrame:
    """The hours of :func:`hour_spine` that ``hourly`` has no row for; keys are not null.

    Spans of ``SPAN_HOURS`` hours meet the hours that their key has there, as two lists of bounded length, so the rows of the
    grid are made where they are used and are neither shuffled nor sorted.
    """
    width = SPAN_HOURS * 3600
    second = F.unix_seconds(F.col(ts).cast("timestamp"))
    span = F.col("_span")
    held = hourly.groupBy(*keys, (second - F.pmod(second, F.lit(width))).alias("_span")).agg(F.collect_set(second).alias("_held"))
    low, high = (F.unix_seconds(F.col(c).cast("timestamp")) for c in (first, last))
    # Spans lie on a fixed scale; the grid itself starts at ``first``.
    spans = F.sequence(low - F.pmod(low, F.lit(width)), high, F.lit(width).cast("bigint"))
    wanted = bounds.withColumns({"_low": low, "_high": high}).select(*keys, "_low", "_high", F.explode(spans).alias("_span"))
    start = F.greatest(F.col("_low"), span + F.pmod(F.col("_low") - span, F.lit(3600)))
    end = F.least(F.col("_high"), span + width - 1)
    hours = F.when(start <= end, F.sequence(start, end, F.lit(3600).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    # As in hour_spine, a fixed number of tasks expands the few spans. By the columns of the join themselves the planner would take the
    # partitions of the join, which adaptive execution makes few, as the spans are small.
    tasks = int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = wanted.join(held, [*keys, "_span"], "left").repartition(tasks, F.xxhash64(*keys, "_span"))
    free = F.array_except(hours, F.coalesce("_held", F.array().cast("array<bigint>")))
    kind = dict(hourly.dtypes)[ts]
    return met.select(*keys, F.explode(free).alias("_hour")).select(
        *keys, F.timestamp_seconds("_hour").cast(kind).alias(ts)
    )


def resample_hourly(
    points: DataFrame,
    *,
    how: str,
    value: str = "value",
    ts: str = TS,
    keys: Sequence[str] = (ZONE, SERIES),
    empty_sum_zero: bool = True,
) -> DataFrame:
    """Hourly mean or sum on a dense grid between a series' first and last hour.

    ``how="rule"`` averages prices and adds up energy, in one pass. An empty hour
    is null for a mean and 0 for a sum (``empty_sum_zero=False`` keeps it null).
    A series without any value yields no rows.
    """
    hourly = hourly_values(points, how=how, value=value, ts=ts, keys=keys)
    # The bounds read the hourly values too, and nulls are gone before grouping,
    # so both branches plan the same aggregation and Spark runs it once.
    bounds = (
        hourly.groupBy(*keys)
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(value).alias("_n"))
        .filter(F.col("_n") > 0)
    )
    return on_grid(hourly, bounds, how=how, value=value, ts=ts, keys=keys, empty_sum_zero=empty_sum_zero)


def _is_mean(how: str) -> Column:
    averaged = {"mean": F.lit(True), "sum": F.lit(False), "rule": F.col(SERIES).contains(PRICE_MARK)}
    if how not in averaged:
        raise ValueError(f"how must be one of {sorted(averaged)}, not {how!r}")
    return averaged[how]


def hourly_values(
    points: DataFrame, *, how: str, value: str = "value", ts: str = TS, keys: Sequence[str] = (ZONE, SERIES)
) -> DataFrame:
    """Hourly mean or sum of the hours that have points; see :func:`resample_hourly`."""
    is_mean = _is_mean(how)
    measured = points.select(*keys, utc_floor("hour", ts).alias(ts), value)
    for column in (*keys, ts, value):
        measured = measured.filter(F.col(column).isNotNull())
    aggregate = {"mean": F.avg(value), "sum": F.sum(value), "rule": F.when(is_mean, F.avg(value)).otherwise(F.sum(value))}
    return measured.groupBy(*keys, ts).agg(aggregate[how].alias(value))


def on_grid(
    hourly: DataFrame,
    bounds: DataFrame,
    *,
    how: str,
    value: str = "value",
    ts: str = TS,
    keys: Sequence[str] = (ZONE, SERIES),
    empty_sum_zero: bool = True,
) -> DataFrame:
    """``hourly`` values on every hour from ``_first`` to ``_last`` of ``bounds`` (one or more rows per series)."""
    filled = hour_spine(bounds, keys, "_first", "_last", ts).join(hourly, [*keys, ts], "left")
    if how != "mean" and empty_sum_zero:
        zero = F.when(~_is_mean(how), F.lit(0).cast(filled.schema[value].dataType))
        filled = filled.withColumn(value, F.coalesce(F.col(value), zero))
    return filled


def union_keep_first(
    parts: Sequence[DataFrame],
    *,
    value: str = "value",
    ts: str = TS,
    keys: Sequence[str] = (ZONE, SERIES),
    order: Sequence[str] = ("chunk_no",),
) -> DataFrame:
    """Concatenate chunks; of repeated timestamps the first chunk's value stays.

    ``min_by`` combines on the map side, so a timestamp repeated in very many
    chunks is reduced before the shuffle.
    """
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return union.groupBy(*keys, ts).agg(F.min_by(value, rank).alias(value))


def year_chunks(ranges: DataFrame, start: str, end: str, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Calendar-year pieces of [start, end], half-open except for the last piece."""
    year_starts = F.sequence(F.trunc(start, "year"), F.to_date(end), F.expr("interval 1 year"))
    pieces = ranges.select(*keys, start, end, F.explode(year_starts).alias("_year")).withColumn(
        "_year", F.col("_year").cast("timestamp_ntz")
    )
    next_year = F.col("_year") + F.make_ym_interval(F.lit(1))
    return (
        pieces.select(
            *keys,
            F.year("_year").cast("bigint").alias("year"),
            F.greatest(F.col(start), F.col("_year")).alias("chunk_start"),
            F.least(F.col(end), next_year).alias("chunk_end"),
            (F.col(end) < next_year).alias("end_inclusive"),
        )
    )


def align_wide(
    long: DataFrame,
    columns: Sequence[str],
    *,
    value: str = "value",
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Union of all timestamps, one column per named series, null where absent.

    One conditional aggregate per series needs a single shuffle on (key, time);
    ``pivot`` would add one on the series name.
    """
    return long.groupBy(*keys, ts).agg(*[F.max(F.when(F.col(SERIES) == c, F.col(value))).alias(c) for c in columns])


def time_slice(df: DataFrame, start: str, end: str, ts: str = TS) -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive."""
    return df.filter(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def sort_time(df: DataFrame, keys: Sequence[str] = (ZONE,), ts: str = TS) -> DataFrame:
    return df.orderBy(*keys, ts)


def daily_mean(df: DataFrame, columns: Sequence[str], *, ts: str = TS, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    return df.groupBy(*keys, utc_floor("day", ts).alias("day")).agg(*[F.avg(c).alias(c) for c in columns])


def week_ending_sunday(ts: str | Column) -> Column:
    return (F.date_trunc("week", ts) + F.expr("interval 6 days")).cast("timestamp_ntz")


def weekly_mean(
    df: DataFrame, columns: dict[str, Column], *, ts: str = TS, keys: Sequence[str] = (ZONE,)
) -> DataFrame:
    """Mean of each named expression per Monday-to-Sunday week, labelled by the Sunday."""
    return df.groupBy(*keys, week_ending_sunday(ts).alias("week_end")).agg(
        *[F.avg(expr).alias(name) for name, expr in columns.items()]
    )


def with_row_sum(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumn(name, row_sum(*columns))


def head_rows(df: DataFrame, n: int, *, keys: Sequence[str] = (ZONE,), ts: str = TS) -> DataFrame:
    return edge_rows(df, keys, ts, n, last=False)


def tail_rows(df: DataFrame, n: int, *, keys: Sequence[str] = (ZONE,), ts: str = TS) -> DataFrame:
    return edge_rows(df, keys, ts, n, last=True)


def with_local_fields(df: DataFrame, *, ts: str = TS, tz: str = MARKET_TZ) -> DataFrame:
    local = local_time(ts, tz)
    return df.withColumns(
        {
            "local_ts": local,
            "local_date": F.to_date(local),
            "local_hour": F.hour(local),
            "local_weekday": day_of_week(local),
            "local_month": F.month(local),
            "local_day": F.dayofmonth(local),
        }
    )
