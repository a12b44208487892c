"""Quality checks from a stored state that new months are added to.

The state holds, for each zone, month and column, the different values with their counts; the timestamp is
a column like others. A month of a zone is bounded by the calendar. It is made in one scan of the rows, months
are replaced without reading others, and every quality table follows from it: counts and extremes directly,
deviations by merging those of months, quantiles by the places of values among all values of a series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattline.config import DOMAIN_BOUNDS, TS, ZONE
from wattline.operators import quality
from wattline.plans.blocks import micros
from wattline.plans.ranks import placed_values
from wattline.plans.sizes import small_side

_TIME = "#time"


def quality_state(df: DataFrame, columns: Sequence[str], *, ts: str = TS, zone: str = ZONE) -> DataFrame:
    """zone, month, column, values (value and n, ascending) of all rows of ``df``, which zone and time must name."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    stamp = F.struct(F.lit(_TIME).alias("column"), micros(ts).cast("double").alias("value"))
    long = df.filter(F.col(zone).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(zone).alias(ZONE), F.date_format(ts, "yyyy-MM").alias("month"), F.inline(F.array(stamp, *cells))
    )
    counts = long.filter("value is not null").groupBy(ZONE, "month", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(ZONE, "month", "column").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("values"))


def updated(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """``state`` with the zones and months of ``fresh`` (a state, too) replaced."""
    touched = fresh.select(ZONE, "month").distinct()
    return state.join(small_side(touched), [ZONE, "month"], "left_anti").unionByName(fresh)


def _months(state: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row per zone, month and column: n, sum, mean and squared deviations of its values, and those outside the bounds."""

    def total(values: Column, term) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda held, v: held + term(v))

    def counted_where(test) -> Column:
        return F.aggregate(F.filter("values", test), F.lit(0).cast("bigint"), lambda held, v: held + v["n"])

    def outside(side) -> Column:
        count = F.lit(None).cast("bigint")
        for column, ends in bounds.items():
            count = F.when(F.col("column") == column, counted_where(side(ends))).otherwise(count)
        return count

    counted = state.withColumns(
        {
            "n": F.aggregate("values", F.lit(0).cast("bigint"), lambda held, v: held + v["n"]),
            "sum": total(F.col("values"), lambda v: v["value"] * v["n"]),
            "below": outside(lambda ends: lambda v: v["value"] < ends[0]),
            "above": outside(lambda ends: lambda v: v["value"] > ends[1]),
        }
    )
    mean = F.col("sum") / F.col("n")
    deviation = total(F.col("values"), lambda v: (v["value"] - mean) * (v["value"] - mean) * v["n"])
    return counted.select(
        ZONE, "month", "column", "n", "sum", "below", "above", deviation.alias("deviation"),
        F.col("values")[0]["value"].alias("least"), F.element_at("values", -1)["value"].alias("most"),
    )


def _column_stats(months: DataFrame, columns: Sequence[str], bounds, dtypes: Mapping[str, str]) -> DataFrame:
    """As ``quality.column_stats``; columns without values have a row for each zone, too."""
    stats = months.filter(F.col("column") != _TIME).groupBy(ZONE, "column").agg(
        F.sum("n").alias("non_null"),
        F.min("least").alias("min"),
        F.max("most").alias("max"),
        (F.sum("sum") / F.sum("n")).alias("mean"),
        F.sum("below").alias("below_count"),
        F.sum("above").alias("above_count"),
        F.collect_list(F.struct("n", (F.col("sum") / F.col("n")).alias("mean"), "deviation")).alias("parts"),
    )
    spread = F.aggregate(
        "parts", F.lit(0.0), lambda held, p: held + p["deviation"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean"))
    )
    stats = stats.withColumn("std", F.when(F.col("non_null") > 1, F.sqrt(spread / (F.col("non_null") - 1)))).drop("parts")
    known = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(dtypes.get(c, "double")).alias("dtype"),
            F.lit(bounds.get(c, (None, None))[0]).cast("double").alias("lower_bound"),
            F.lit(bounds.get(c, (None, None))[1]).cast("double").alias("upper_bound"),
        )
        for c in columns
    ]
    rows = months.filter(F.col("column") == _TIME).groupBy(ZONE).agg(F.sum("n").alias("n_rows"))
    every = rows.select(ZONE, "n_rows", F.inline(F.array(*known)))
    counts = {"non_null": F.coalesce("non_null", F.lit(0))}
    for side in ("below_count", "above_count"):
        counts[side] = F.when(F.col("lower_bound").isNotNull(), F.coalesce(side, F.lit(0)))
    return every.join(stats, [ZONE, "column"], "left").withColumns(counts)


def _range_stats(flat: DataFrame, stats: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    """Extremes and exact quantiles of every zone and column with values."""
    distinct = flat.filter(F.col("column") != _TIME).groupBy(ZONE, "column", "value").agg(F.sum("n").alias("_n"))
    places = placed_values(distinct, [ZONE, "column"], "value").join(
        small_side(stats.select(ZONE, "column", "non_null", "min", "max")), [ZONE, "column"]
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_less") <= rank) & (rank < F.col("_less") + F.col("_n")), F.col("value")))

    ranks = {name: F.lit(q) * (F.col("non_null") - 1) for name, q in probabilities.items()}
    ends = [e for name, r in ranks.items() for e in (at(F.floor(r)).alias(f"_a{name}"), at(F.ceil(r)).alias(f"_b{name}"))]
    found = places.groupBy(ZONE, "column", "non_null", "min", "max").agg(*ends)
    picked = [
        F.when(F.col(f"_a{n}") == F.col(f"_b{n}"), F.col(f"_a{n}"))
        .otherwise((F.ceil(r) - r) * F.col(f"_a{n}") + (r - F.floor(r)) * F.col(f"_b{n}"))
        .alias(n)
        for n, r in ranks.items()
    ]
    return found.select(ZONE, "column", "min", "max", *picked)


def tables_from_state(
    state: DataFrame,
    columns: Sequence[str],
    *,
    bounds: Mapping[str, tuple[float, float]] = DOMAIN_BOUNDS,
    dtypes: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All quality tables, as ``plans.pipeline.quality_tables`` gives them, and ``profile``, from a stored ``state``."""
    bounds = {c: bounds[c] for c in columns if c in bounds}
    flat = state.select(ZONE, "month", "column", F.inline("values"))
    time = F.timestamp_micros(F.col("value").cast("bigint")).cast("timestamp_ntz")
    stamps = flat.filter(F.col("column") == _TIME).select(ZONE, "month", time.alias(TS), "n")
    repeats = stamps.select(ZONE, TS, (F.col("n") - 1).alias("_extra"))
    months = _months(state, bounds)
    stats = _column_stats(months, columns, bounds, dtypes or {})
    spans = stamps.groupBy(ZONE).agg(F.sum("n").alias("n_rows"), F.min(TS).alias("start"), F.max(TS).alias("end"))
    by_month = months.groupBy(ZONE, F.last_day(F.to_date(F.concat("month", F.lit("-01")))).alias("month_end")).agg(
        F.sum(F.when(F.col("column") == _TIME, F.col("n"))).alias("_rows"),
        *[F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0)).alias(c) for c in columns],
    )
    stamp_stats = quality.timestamp_stats_of(repeats)
    checks = quality.judge(stats, stamp_stats)
    return {
        "overview": quality.overview_of(spans, columns),
        "missing": quality.missing(stats),
        "timestamps": stamp_stats,
        "duplicate_examples": quality.duplicate_examples_of(repeats),
        "gap_examples": quality.gap_examples(stamps),
        "outliers": quality.bound_violations(stats),
        "range_stats": _range_stats(flat, stats, {"p01": 0.01, "p99": 0.99}),
        "monthly_coverage": quality.coverage_of(by_month, columns),
        "issues": quality.issues(checks),
        "verdict": quality.verdict(checks),
        "profile": quality.profile(stats),
    }
