"""Places of values among all values of a series, without sorting a series in one task.

Rows are reduced to one per different value first, with its count, so a value that a third of all rows share is one row.
Values fall into ranges between approximate quantiles; counts of whole ranges are summed per series, and only values of one range are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wattline.plans.sizes import small_side

#: Value ranges of a series.
RANGES = 512


def value_places(rows: DataFrame, keys: Sequence[str], value: str, position: str, ranges: int = RANGES) -> DataFrame:
    """keys, ``value``, _n, _first, _last, _less, _kinds: one row per different value of each series.

    ``_n`` rows hold the value, at positions ``_first`` to ``_last``; ``_less`` rows and ``_kinds`` different values
    are smaller. Missing values are left out.
    """
    distinct = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"), F.max(position).alias("_last"))
    )
    return placed_values(distinct, keys, value, ranges)


def placed_values(distinct: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``distinct`` (one row per different value, held by ``_n`` rows) with ``_less`` and ``_kinds``; see :func:`value_places`."""
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = small_side(distinct.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, cuts, 4 * ranges)).alias("_bounds")))
    # Binary search: the number of bounds up to the value, built from falling powers of two.
    steps = F.lit([1 << i for i in reversed(range(max(ranges - 1, 1).bit_length()))])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size("_bounds")) & (F.get("_bounds", at + step - 1) <= F.col(value)), at + step
        ).otherwise(at),
    )
    ranged = distinct.join(bounds, list(keys)).withColumn("_range", place).drop("_bounds")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_values").over(earlier), F.lit(0)).alias("_values_before"),
        )
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts.hint("shuffle_hash"), [*keys, "_range"])
        .withColumns(
            {
                "_less": F.col("_rows_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)),
                "_kinds": F.col("_values_before") + F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)),
            }
        )
        .drop("_range", "_rows_before", "_values_before")
    )
