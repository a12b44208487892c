"""Steps of rules on series that are no longer than a block: such a series is whole in a task, and all its steps are made there.

Rows are shuffled once, wide and by zone: a group holds many whole zones, and a step is made for all its series at
once. Values that follow from other rows come back beside the value, so predicates stay expressions of Spark.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattline.functions.order_statistics import window_quantiles
from wattline.operators.series_text import Program, Step
from wattline.plans.blocks import micros
from wattline.plans.scans import faded

#: Steps that are made here; others need expressions or windows of Spark between two rows.
KINDS = ("lag", "order", "scan", "rank", "repeat", "scalar", "changes", "above")
#: Rows of a group, about.
GROUP_ROWS = 1 << 15


def whole_columns(program: Program, columns: Sequence[str]) -> list[str]:
    """Columns all of whose steps are made here."""
    return [c for c in columns if all(s.kind in KINDS for s, _ in steps_of(program, c))]


def steps_of(program: Program, column: str) -> list[tuple[Step, str]]:
    return [(s, n) for s, n in program.steps.items() if column in program.made[n].columns]


def fits(df: DataFrame, columns: Sequence[str], ts: str, zone: str, most: int) -> int:
    """The number of rows of ``df`` if no zone has more than ``most``, every row has a time, and all values are finite; else 0."""
    odd = [F.count_if(~(F.abs(F.col(c).cast("double")) < float("inf"))) for c in columns]
    zones = df.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), sum(odd, F.count_if(F.col(ts).isNull())).alias("odd"))
    found = zones.agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.sum("odd").alias("odd")).first()
    return found["all"] if found["all"] and found["most"] <= most and not found["odd"] else 0


def sequence_predicate(program: Program, column: str, kind: str, args: Sequence[float], first_row_passes: bool) -> str | None:
    """The rule ``jump``, ``flatline`` or ``spike`` on a column as a predicate on steps, which ``program`` takes; None if they cannot be made here."""
    reads = frozenset(["_value"])
    if kind == "spike":
        threshold, size, allowed = args
        if int(size) < 0:
            return None
        recent = program.column(Step("above", "_value", (threshold, int(size))), reads, column)
        return f"(_value <= cast({threshold!r} as double) or {recent} <= {int(allowed)})"
    before = program.column(Step("lag", "_value", (1,)), reads, column, back=1)
    if kind == "jump":
        return f"coalesce(abs(_value - {before}) <= cast({args[0]!r} as double), {str(first_row_passes).lower()})"
    first = f"{before} is null" if first_row_passes else "false"
    if int(args[0]) < 2:
        return f"({first})"
    changes = program.column(Step("changes", "_value", (int(args[0]) - 1,)), reads, column)
    return f"({changes} > 0 or {first})"


def judged_rows(
    df: DataFrame, program: Program, judged: list[tuple[int, str, str, str]], ts: str, zone: str, rows: int
) -> tuple[DataFrame, dict[int, tuple[Column, Column]]]:
    """Rows with ``_zone`` and, by rule number, whether a row has a value and whether that is a violation; see ``series_counts``."""
    columns = sorted({c for _, c, _, _ in judged})
    steps = {c: steps_of(program, c) for c in columns}
    values = [F.col(c).cast("double").alias(f"_value_{i}") for i, c in enumerate(columns)]
    group = F.pmod(F.xxhash64(zone), F.lit(-(-rows // GROUP_ROWS)).cast("long"))
    given = df.where(F.col(zone).isNotNull()).select(
        group.alias("_group"), F.col(zone).alias("_zone"), micros(ts).alias("_at"), *values
    )
    fields = [
        (f"{name}_{i}", "boolean" if step is not None and step.kind == "repeat" else "double")
        for i, c in enumerate(columns)
        for step, name in [(None, "_value"), *steps[c]]
    ]
    schema = ", ".join([f"_zone {given.schema['_zone'].dataType.simpleString()}", *(f"`{n}` {kind}" for n, kind in fields)])

    def made(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        codes = table.column("_zone").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((table.column("_at").to_numpy(), codes))
        found = [table.column("_zone").take(pa.array(order))]
        for i, c in enumerate(columns):
            value = table.column(f"_value_{i}").to_numpy()[order]
            present = np.flatnonzero(~np.isnan(value))
            own = series_steps(value[present], codes[order][present], steps[c])
            for step, name in [(None, "_value"), *steps[c]]:
                whole = np.full(len(value), np.nan)
                whole[present] = own[name]
                missing = np.isnan(whole)
                repeat = step is not None and step.kind == "repeat"
                found.append(pa.array(whole == 1 if repeat else whole, mask=missing))
        return pa.table(found, names=["_zone", *(n for n, _ in fields)])

    rows_of = given.groupBy("_group").applyInArrow(made, schema)
    verdicts = {}
    # The names of a column's steps are those of the program while its predicates are resolved; the optimizer folds the projections into one.
    for i, c in enumerate(columns):
        names = ["_value", *(name for _, name in steps[c])]
        checks = []
        for n, column, predicate, kept in judged:
            if column == c:
                checks += [F.col("_value").isNotNull().alias(f"_mine{n}"), (~F.expr(predicate) & (F.expr(kept) if kept else F.lit(True))).alias(f"_bad{n}")]
                verdicts[n] = F.col(f"_mine{n}"), F.col(f"_mine{n}") & F.col(f"_bad{n}")
        rows_of = rows_of.withColumnsRenamed({f"{name}_{i}": name for name in names}).select("*", *checks).drop(*names)
    return rows_of, verdicts


def series_steps(values: np.ndarray, series: np.ndarray, steps: Sequence[tuple[Step, str]]) -> dict[str, np.ndarray]:
    """Columns by name: ``_value`` and that of each step, for many series of ``values`` one after another; NaN is missing.

    ``series`` tells the series of each value. Truth is 1 or 0.
    """
    made = {"_value": values}
    first = np.flatnonzero(np.diff(series, prepend=-1))
    sizes = np.diff(first, append=len(values))
    low = np.repeat(first, sizes)
    high = low + np.repeat(sizes, sizes)
    for step, name in steps:
        x = made[step.source]
        if not len(x):
            made[name] = x
        elif step.kind == "lag":
            at = np.arange(len(x)) - step.args[0]
            made[name] = np.where((at >= low) & (at < high), x[np.clip(at, 0, len(x) - 1)], np.nan)
        elif step.kind == "order":
            q, size, least, ahead = step.args
            (made[name],) = window_quantiles(x, size, ahead, [(q, least)], low, high)
        elif step.kind == "scan":
            made[name] = _scan(x, first, sizes, *step.args)
        elif step.kind in ("changes", "above"):
            # How many of the last values differ from the one before, or are above a limit.
            *limit, rows = step.args
            counted = x > limit[0] if limit else np.append(False, x[1:] != x[:-1]) & (np.arange(len(x)) > low)
            before = np.concatenate(([0], np.cumsum(counted)))
            at = np.arange(len(x)) + 1
            made[name] = (before[at] - before[np.maximum(at - rows, low)]).astype(float)
        elif step.kind == "scalar":
            made[name] = np.repeat(_scalar(x, first, sizes, *step.args), sizes)
        else:
            made[name] = _place(x, first, sizes, step)
    return made


def _scan(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, kind: str, *args) -> np.ndarray:
    parts = [slice(a, a + n) for a, n in zip(first.tolist(), sizes.tolist())]
    found = np.empty(len(x))
    if kind == "ewm":
        keep, mean = args
        for part in parts:
            fed = x[part]
            if not mean:
                fed = np.where(np.arange(len(fed)) == 0, fed, fed * (1 - keep))
            found[part] = faded(fed, keep)
        if mean and keep > 0:
            place = np.arange(len(x)) - np.repeat(first, sizes)
            found /= -np.expm1((place + 1) * math.log(keep)) / (1 - keep)
        return found
    present = ~np.isnan(x)
    count = np.cumsum(present)
    count = count - np.repeat(count[first] - present[first], sizes)
    if kind == "count":
        found = count.astype(float)
    else:
        running, none = {"sum": (np.add, 0.0), "min": (np.minimum, np.inf), "max": (np.maximum, -np.inf)}[kind]
        held = np.where(present, x, none)
        for part in parts:
            running.accumulate(held[part], out=found[part])
        found[count == 0] = np.nan
    if args[0]:
        found[~present] = np.nan
    return found


def _ordered(x: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values in the order of series and value; series of each; where a new value starts."""
    series = np.repeat(np.arange(len(first)), sizes)
    order = np.flatnonzero(~np.isnan(x))
    order = order[np.lexsort((x[order], series[order]))]
    series, value = series[order], x[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (series[1:] != series[:-1]) | (value[1:] != value[:-1])
    return order, series, fresh


def _place(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, step: Step) -> np.ndarray:
    order, series, fresh = _ordered(x, first, sizes)
    found = np.full(len(x), np.nan)
    if not len(order):
        return found
    starts = np.flatnonzero(fresh)
    n = np.diff(starts, append=len(order))
    of = series[starts]
    if step.kind == "repeat":
        ends = {"first": np.minimum.reduceat(order, starts), "last": np.maximum.reduceat(order, starts)}
        other = order != np.repeat(ends[step.args[0]], n) if step.args[0] in ends else np.repeat(n > 1, n)
        found[order] = other
        return found
    method, ascending, share = step.args
    every, kinds = np.bincount(of, weights=n, minlength=len(first))[of], np.bincount(of, minlength=len(first))[of]
    fresh_series = np.flatnonzero(np.diff(of, prepend=-1))
    many = np.diff(fresh_series, append=len(of))
    low = starts - np.repeat(starts[fresh_series], many)
    before = np.arange(len(of)) - np.repeat(fresh_series, many)
    if not ascending:
        low = every - low - n
    dense = before + 1 if ascending else kinds - before
    rank = {"average": low + (n + 1) / 2, "min": low + 1, "max": low + n, "dense": dense}[method].astype(float)
    found[order] = np.repeat(rank / (kinds if method == "dense" else every) if share else rank, n)
    return found


def _scalar(x: np.ndarray, first: np.ndarray, sizes: np.ndarray, kind: str, *args) -> np.ndarray:
    """One value of each series."""
    present = ~np.isnan(x)
    count = np.add.reduceat(present.astype(np.int64), first)
    if kind in ("size", "count"):
        return (sizes if kind == "size" else count).astype(float)
    if kind in ("min", "max"):
        least, none = (np.minimum, np.inf) if kind == "min" else (np.maximum, -np.inf)
        return np.where(count > 0, least.reduceat(np.where(present, x, none), first), np.nan)
    if kind in ("median", "quantile", "nunique"):
        order, series, fresh = _ordered(x, first, sizes)
        if kind == "nunique":
            return np.bincount(series[fresh], minlength=len(first)).astype(float)
        if not len(order):
            return np.full(len(first), np.nan)
        value = x[order]
        place = (0.5 if kind == "median" else args[0]) * np.maximum(count - 1, 0)
        below, above = np.floor(place), np.ceil(place)
        start = np.minimum(np.cumsum(count) - count, len(value) - 1)
        a, b = (value[np.minimum(start + at.astype(np.int64), len(value) - 1)] for at in (below, above))
        # The same arithmetic as the built-in percentile.
        return np.where(count > 0, np.where(a == b, a, (above - place) * a + (place - below) * b), np.nan)
    total = np.add.reduceat(np.where(present, x, 0.0), first)
    if kind == "sum":
        return total
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = total / count
        if kind == "mean":
            return mean
        squares = np.add.reduceat(np.where(present, x - np.repeat(mean, sizes), 0.0) ** 2, first)
        variance = np.where(count > 0, squares, np.nan) / count if kind.endswith("_pop") else np.where(count > 1, squares / (count - 1), np.nan)
    return np.sqrt(variance) if kind.startswith("std") else variance
