"""Standard data-quality checks, one small table per check and zone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.config import DOMAIN_BOUNDS, HOUR_MICROS, TS, ZONE
from wattline.functions.numbers import share
from wattline.functions.quantiles import grouped_quantiles
from wattline.operators.shaping import hour_spine
from wattline.plans.blocks import floor_div, micros

MISSING_LIMIT = 0.05
GAP_LIMIT = 24
EXAMPLES = 5

Bounds = Mapping[str, tuple[float, float]]


def _hours_between(first: str, last: str) -> Column:
    return floor_div(micros(last) - micros(first), HOUR_MICROS)


def overview(df: DataFrame, columns: Sequence[str], *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Row and column counts, covered period and the rows a full grid would have."""
    spans = df.groupBy(zone).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return overview_of(spans, columns)


def overview_of(spans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``spans`` (zone, n_rows, start, end) as an overview."""
    return (
        spans.withColumn("n_cols", F.lit(len(columns)).cast("bigint"))
        .withColumn("columns", F.lit(",".join(columns)))
        .withColumn("expected_hourly_rows", _hours_between("start", "end") + 1)
    )


def column_stats(df: DataFrame, columns: Sequence[str], *, bounds: Bounds = DOMAIN_BOUNDS, zone: str = ZONE) -> DataFrame:
    """Counts, moments and bound violations of all columns in one aggregate pass.

    Long form, one row per zone and column. Bound counts are null for a column
    without bounds.
    """

    def wide(c: str) -> list[Column]:
        lo, hi = bounds.get(c, (None, None))
        outside = [F.lit(None).cast("bigint").alias(f"{c}#below"), F.lit(None).cast("bigint").alias(f"{c}#above")]
        if c in bounds:
            outside = [F.count_if(F.col(c) < lo).alias(f"{c}#below"), F.count_if(F.col(c) > hi).alias(f"{c}#above")]
        return [
            F.count(c).alias(f"{c}#n"),
            F.min(c).alias(f"{c}#min"),
            F.max(c).alias(f"{c}#max"),
            F.avg(c).alias(f"{c}#mean"),
            F.stddev_samp(c).alias(f"{c}#std"),
            *outside,
        ]

    def unfold(c: str) -> Column:
        part = lambda name: F.col(f"`{c}#{name}`")
        lo, hi = bounds.get(c, (None, None))
        return F.struct(
            F.lit(c).alias("column"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            part("n").alias("non_null"),
            part("min").cast("double").alias("min"),
            part("max").cast("double").alias("max"),
            part("mean").alias("mean"),
            part("std").alias("std"),
            F.lit(lo).cast("double").alias("lower_bound"),
            F.lit(hi).cast("double").alias("upper_bound"),
            part("below").alias("below_count"),
            part("above").alias("above_count"),
        )

    aggregates = [a for c in columns for a in wide(c)]
    return (
        df.groupBy(zone)
        .agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
        .select(zone, "n_rows", F.inline(F.array(*[unfold(c) for c in columns])))
    )


def missing(stats: DataFrame, zone: str = ZONE) -> DataFrame:
    count = F.col("n_rows") - F.col("non_null")
    return stats.select(
        zone, "column", count.alias("missing_count"), share(count, F.col("n_rows")).alias("missing_fraction")
    )


def bound_violations(stats: DataFrame, zone: str = ZONE) -> DataFrame:
    """Values strictly outside their bounds; columns without bounds are left out."""
    return stats.filter(F.col("lower_bound").isNotNull()).select(
        zone, "column", "lower_bound", "upper_bound", "below_count", "above_count"
    )


def profile(stats: DataFrame, zone: str = ZONE) -> DataFrame:
    return stats.select(zone, "column", "dtype", "non_null", "min", "max", "mean", "std")


def range_stats(df: DataFrame, columns: Sequence[str], *, zone: str = ZONE, **options) -> DataFrame:
    """Minimum, maximum and exact 1 % / 99 % quantiles per zone and column.

    A column without values in a zone has no row.
    """
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(zone, *doubles).unpivot([zone], list(columns), "column", "value")
    quantiles = grouped_quantiles(long, [zone, "column"], "value", {"p01": 0.01, "p99": 0.99}, **options)
    ends = [
        F.struct(F.lit(c).alias("column"), F.col(f"{c}#min").alias("min"), F.col(f"{c}#max").alias("max"))
        for c in columns
    ]
    extremes = df.groupBy(zone).agg(
        *[a for c in columns for a in (F.min(F.col(c).cast("double")).alias(f"{c}#min"), F.max(F.col(c).cast("double")).alias(f"{c}#max"))]
    )
    # One row per zone and column on both sides.
    return extremes.select(zone, F.inline(F.array(*ends))).join(quantiles.drop("n"), [zone, "column"])


def _repeats(df: DataFrame, ts: str, zone: str) -> DataFrame:
    return df.groupBy(zone, ts).agg((F.count(F.lit(1)) - 1).alias("_extra"))


def timestamp_stats(df: DataFrame, *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Repeated rows and missing grid hours per zone, in one pass and without a grid.

    The hourly grid starts at the first timestamp, so the hours on it share that
    timestamp's offset within the hour.
    """
    return timestamp_stats_of(_repeats(df, ts, zone), ts, zone)


def timestamp_stats_of(repeats: DataFrame, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """As :func:`timestamp_stats`, from one row per timestamp with ``_extra`` repetitions."""
    by_offset = (
        repeats.groupBy(zone, F.pmod(micros(ts), F.lit(HOUR_MICROS)).alias("_offset"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_extra").alias("_extra"),
            F.min(ts).alias("_first"),
            F.max(ts).alias("_last"),
        )
    )
    return (
        by_offset.groupBy(zone)
        .agg(
            F.sum("_extra").alias("duplicate_count"),
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.min_by("_n", "_first").alias("_on_grid"),
        )
        .select(zone, "duplicate_count", (_hours_between("_first", "_last") + 1 - F.col("_on_grid")).alias("gap_count"))
    )


def duplicate_counts(df: DataFrame, *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Rows whose timestamp already occurred in the zone."""
    return timestamp_stats(df, ts=ts, zone=zone).select(zone, "duplicate_count")


def gap_counts(df: DataFrame, *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Number of missing hours between first and last timestamp."""
    return timestamp_stats(df, ts=ts, zone=zone).select(zone, "gap_count")


def duplicate_examples(df: DataFrame, n: int = EXAMPLES, *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """The first ``n`` repeated rows; a timestamp shows once per extra row."""
    return duplicate_examples_of(_repeats(df, ts, zone), n, ts, zone)


def duplicate_examples_of(repeats: DataFrame, n: int = EXAMPLES, ts: str = TS, zone: str = ZONE) -> DataFrame:
    shown = F.sequence(F.lit(1), F.least(F.col("_extra"), F.lit(n)).cast("int"))
    repeated = repeats.filter(F.col("_extra") > 0)
    return _first(repeated.select(zone, ts, F.explode(shown).alias("_copy")), n, [ts, "_copy"], zone).select(
        zone, "example_no", ts
    )


def _first(df: DataFrame, n: int, order: Sequence[str], zone: str) -> DataFrame:
    ranked = df.withColumn("example_no", F.row_number().over(Window.partitionBy(zone).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("example_no") <= n)


def gap_hours(df: DataFrame, *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Hours of the grid from first to last timestamp that have no row."""
    # Nulls go first, so that both uses of ``present`` share one shuffle.
    present = df.select(zone, ts).filter(F.col(zone).isNotNull() & F.col(ts).isNotNull()).distinct()
    ends = present.groupBy(zone).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    return hour_spine(ends, [zone], "_first", "_last", ts).join(present, [zone, ts], "left_anti")


def gap_examples(df: DataFrame, n: int = EXAMPLES, *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    return _first(gap_hours(df, ts=ts, zone=zone), n, [ts], zone).select(zone, "example_no", ts)


def monthly_coverage(df: DataFrame, columns: Sequence[str], *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """Share of non-null values per UTC month, keyed by month end.

    A month without rows between the first and last month has null coverage.
    """
    by_month = df.groupBy(zone, F.last_day(ts).alias("month_end")).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]
    )
    return coverage_of(by_month, columns, zone)


def coverage_of(by_month: DataFrame, columns: Sequence[str], zone: str = ZONE) -> DataFrame:
    """As :func:`monthly_coverage`, from the number of rows (``_rows``) and of values of each month that has rows."""
    # Months without rows are generated up to the next month that has some; a
    # zone has few months, and the data are scanned once.
    start = F.trunc("month_end", "month")
    upcoming = F.lead(start).over(Window.partitionBy(zone).orderBy("month_end"))
    months = F.sequence(start, F.coalesce(F.add_months(upcoming, -1), start), F.expr("interval 1 month"))
    spread = by_month.withColumn("_months", months).select("*", F.explode("_months").alias("_month"))
    present = F.last_day("_month") == F.col("month_end")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.when(present, share(F.col(c), F.col("_rows"))).alias("coverage"))
            for c in columns
        ]
    )
    return spread.select(zone, F.last_day("_month").alias("month_end"), F.inline(cells))


def judge(
    stats: DataFrame,
    stamps: DataFrame,
    *,
    missing_limit: float = MISSING_LIMIT,
    gap_limit: int = GAP_LIMIT,
    zone: str = ZONE,
) -> DataFrame:
    """Every threshold check per zone with its magnitude, message and outcome.

    ``stats`` comes from :func:`column_stats`, ``stamps`` from
    :func:`timestamp_stats`.
    """

    def check(kind, column, magnitude, message, broken):
        return F.struct(
            F.lit(kind).alias("kind"),
            column.alias("column"),
            magnitude.cast("double").alias("magnitude"),
            message.alias("message"),
            F.coalesce(broken, F.lit(False)).alias("is_issue"),
        )

    column, stamp = F.col("column"), F.lit(TS)
    absent = F.round((F.col("n_rows") - F.col("non_null")) / F.col("n_rows"), 4)
    outside = F.col("below_count") + F.col("above_count")
    per_column = stats.select(
        zone,
        F.inline(
            F.array(
                check("missing", column, absent, F.format_string("%s: %.1f%% missing", column, absent * 100), absent > missing_limit),
                check("bounds", column, outside, F.format_string("%s: %d domain-bound violations", column, outside), outside > 0),
            )
        ),
    )
    repeats, gaps = F.col("duplicate_count"), F.col("gap_count")
    per_zone = stamps.select(
        zone,
        F.inline(
            F.array(
                check("duplicates", stamp, repeats, F.format_string("%d duplicate timestamps", repeats), repeats > 0),
                check("gaps", stamp, gaps, F.format_string("%d hourly gaps", gaps), gaps > gap_limit),
            )
        ),
    )
    return per_column.unionByName(per_zone)


def issues(checks: DataFrame) -> DataFrame:
    """The checks of :func:`judge` that broke their threshold."""
    return checks.filter("is_issue").drop("is_issue")


def verdict(checks: DataFrame, zone: str = ZONE) -> DataFrame:
    """One row per zone: number of issues and whether there is none."""
    counted = checks.groupBy(zone).agg(F.count_if("is_issue").alias("n_issues"))
    return counted.withColumn("passed", F.col("n_issues") == 0)


def column_report(stats: DataFrame, ranges: DataFrame, zone: str = ZONE) -> DataFrame:
    """Completeness beside value range and outlier counts, one row per column."""
    completeness = missing(stats, zone).select(zone, "column", (F.col("missing_fraction") * 100).alias("missing_pct"))
    outliers = bound_violations(stats, zone).select(zone, "column", "below_count", "above_count")
    return completeness.join(outliers, [zone, "column"], "left").join(ranges, [zone, "column"], "left")
