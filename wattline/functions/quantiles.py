"""Exact linear-interpolated quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wattline.plans.sizes import small_side
from wattline.session import settle

WHOLE_GROUP = 100_000
GRID_STEPS = 200
GRID_ACCURACY = 2_000


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    whole_group: int = WHOLE_GROUP,
) -> DataFrame:
    """One row per group: ``keys``, ``n`` and one column per named probability.

    The built-in exact percentile holds the distinct values of a group in one
    task, so it serves groups of up to ``whole_group`` values. In a larger group
    each wanted rank is first enclosed in a value bracket; only values inside
    the bracket are ordered.
    """
    values = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    large = small_side(
        values.groupBy(*keys)
        .agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        .filter(F.col("n") > whole_group)
    )
    if large.isEmpty():
        return _whole(values, keys, probabilities)
    small = values.join(large.select(*keys), list(keys), "left_anti")
    enclosed = _enclosed(values, keys, large, probabilities, whole_group)
    return _whole(small, keys, probabilities).unionByName(enclosed)


def _whole(values: DataFrame, keys: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    wanted = F.array(*[F.lit(q) for q in probabilities.values()])
    grouped = values.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile("_v", wanted).alias("_q"))
    return grouped.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)])


def _enclosed(values, keys, large: DataFrame, probabilities: dict[str, float], whole_group: int) -> DataFrame:
    wanted = [
        F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("rank"))
        for name, q in probabilities.items()
    ]
    brackets = large.select(*keys, "n", F.inline(F.array(*wanted)), "low", "high")
    before = None
    while True:
        # One row per large group and rank, written out so that rounds do not
        # pile up in one plan.
        narrowed = settle(values.sparkSession, _narrow(values, keys, brackets), "quantile-brackets")
        brackets = narrowed.drop("_held")
        held = narrowed.agg(F.max("_held").alias("most"), F.sum("_held").alias("all")).first()
        if (held["most"] or 0) <= whole_group:
            break
        if before is not None and held["all"] >= before:
            raise RuntimeError("quantile brackets do not shrink")
        before = held["all"]
    return _read_off(values, keys, brackets, list(probabilities))


def _narrow(values: DataFrame, keys: Sequence[str], brackets: DataFrame) -> DataFrame:
    """One pass: count what lies below, on and inside each bracket, and shrink it.

    A sketch of the values inside gives grid quantiles whose rank error is a
    tenth of a grid step; the new bracket leaves a whole step on either side.
    Values equal to an end are counted apart, so repeated values cannot stop the
    shrinking. ``_held`` bounds the number of values left strictly inside.
    """
    v, low, high = F.col("_v"), F.col("low"), F.col("high")
    inner = (v > low) & (v < high)
    grid = [i / GRID_STEPS for i in range(GRID_STEPS + 1)]
    counted = (
        values.join(small_side(brackets), list(keys))
        .groupBy(*keys, "n", "name", "rank", "low", "high")
        .agg(
            F.count_if(v <= low).alias("_upto_low"),
            F.count_if(inner).alias("_inner"),
            F.percentile_approx(F.when(inner, v), grid, GRID_ACCURACY).alias("_grid"),
        )
    )
    first, last = F.floor("rank"), F.ceil("rank")
    upto_low, count = F.col("_upto_low"), F.col("_inner")
    start = F.floor((first - upto_low) / F.greatest(count, F.lit(1)) * GRID_STEPS) - 1
    end = F.ceil((last - upto_low) / F.greatest(count, F.lit(1)) * GRID_STEPS) + 1
    placed = counted.withColumns({"_start": F.greatest(start, F.lit(0)), "_end": F.least(end, F.lit(GRID_STEPS))})
    on_low, on_high = last < upto_low, first >= upto_low + count
    slack = F.lit(2.0 / GRID_ACCURACY)
    held = F.ceil(count * ((F.col("_end") - F.col("_start")) / GRID_STEPS + slack))
    return placed.select(
        *keys,
        "n",
        "name",
        "rank",
        F.when(on_low, low).when(on_high, high).when(F.col("_start") > 0, F.col("_grid")[F.col("_start").cast("int")])
        .otherwise(low).alias("low"),
        F.when(on_low, low).when(on_high, high).when(F.col("_end") < GRID_STEPS, F.col("_grid")[F.col("_end").cast("int")])
        .otherwise(high).alias("high"),
        F.when(on_low | on_high, 0).otherwise(held).cast("bigint").alias("_held"),
    )


def _read_off(values: DataFrame, keys: Sequence[str], brackets: DataFrame, names: Sequence[str]) -> DataFrame:
    """Order the distinct values inside each bracket and pick the two ranks around the target.

    All values below a bracket share one NULL cell, which the map side already
    reduces to a count. A rank outside its bracket stops the query.
    """
    group = [*keys, "n", "name", "rank"]
    cells = (
        values.join(small_side(brackets), list(keys))
        .filter(F.col("_v") <= F.col("high"))
        .groupBy(*group, F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_cell"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    order = Window.partitionBy(*group).orderBy(F.col("_cell").asc_nulls_first())
    upto = F.sum("_count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen, before = F.col("_upto"), F.col("_upto") - F.col("_count")

    def at(index):
        return F.max(F.when((before <= index) & (index < seen), F.col("_cell")))

    picked = (
        cells.withColumn("_upto", upto)
        .groupBy(*group)
        .agg(at(F.floor("rank")).alias("_a"), at(F.ceil("rank")).alias("_b"))
    )
    # The same arithmetic as the built-in percentile, so groups of any size agree to the last digit.
    weighted = (F.ceil("rank") - F.col("rank")) * F.col("_a") + (F.col("rank") - F.floor("rank")) * F.col("_b")
    exact = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("double")).otherwise(weighted)
    missing = F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")
    checked = picked.withColumn("_q", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), exact).otherwise(missing))
    return checked.groupBy(*keys, "n").agg(
        *[F.max(F.when(F.col("name") == name, F.col("_q"))).alias(name) for name in names]
    )
