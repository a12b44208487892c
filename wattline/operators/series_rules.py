"""Counts violations of rules in series notation over any number of long series.

All rules share one table of (zone, column, position, value). Steps are made in passes. Inside a pass, steps that look at
neighbouring rows follow each other in one block layout, whose halo is as long as the longest chain of them. Between two
passes come the steps that need whole series: running values, places among all values, and single values, which are
joined by (zone, column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wattline.config import HOUR_MICROS
from wattline.functions.quantiles import grouped_quantiles
from wattline.operators.series_text import Program, Step
from wattline.plans.blocks import BLOCK_STEPS, BlockedSeries, block_series, row_positions
from wattline.plans.ranks import value_places
from wattline.plans.scans import Scan, with_scans
from wattline.plans.sizes import small_side
from wattline.plans.sliding import WindowQuantile, with_window_quantiles
from wattline.session import settle

_ROW = "_row"
_KEYS = ("_zone", "_column")


def series_counts(
    df: DataFrame, program: Program, judged: list[tuple[int, str, str, str]], ts: str, zone: str, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """One row per zone: ``v<number>`` violations and ``n<number>`` values of every rule.

    ``judged`` holds (number, column, predicate, condition under which a row is judged) of rules that ``program`` has read.
    """
    columns = sorted({c for _, c, _, _ in judged})
    doubles = [F.col(c).cast("double").alias(c) for c in columns]
    long = (
        df.select(F.col(zone).alias("_zone"), F.col(ts).alias("_ts"), *doubles)
        .unpivot(["_zone", "_ts"], columns, "_column", "_value")
        .filter(F.col("_value").isNotNull())
    )
    rows = long
    if program.steps:
        rows = row_positions(long, _KEYS, "_ts", span_micros=block_steps * HOUR_MICROS).withColumnRenamed("_pos", _ROW)
        rows = _evaluated(rows.drop("_ts"), program, block_steps)
    aggregates = []
    for n, column, predicate, kept in judged:
        mine = F.col("_column") == column
        bad = mine & ~F.expr(predicate) & (F.expr(kept) if kept else F.lit(True))
        aggregates += [F.count_if(bad).alias(f"v{n}"), F.count_if(mine).alias(f"n{n}")]
    return rows.groupBy(F.col("_zone").alias(zone)).agg(*aggregates)


def _evaluated(rows: DataFrame, program: Program, block_steps: int) -> DataFrame:
    made, names = program.made, program.steps
    phases = 1 + max(m.phase for m in made.values())
    if phases > 1:
        rows = settle(rows.sparkSession, rows, "rule-rows")
    for phase in range(phases):
        whole = [(s, n) for s, n in names.items() if s.kind in ("scan", "rank", "repeat", "scalar") and made[n].phase == phase]
        if whole:
            rows = _with_whole(rows, whole, made, block_steps)
        near = [(s, n) for s, n in names.items() if s.kind not in ("scan", "rank", "repeat", "scalar") and made[n].phase == phase]
        if near:
            rows = _with_near(rows, near, made, block_steps)
        if whole and phase < phases - 1:
            rows = settle(rows.sparkSession, rows, "rule-rows")
    return rows


def _with_near(rows: DataFrame, steps: list[tuple[Step, str]], made, block_steps: int) -> DataFrame:
    back, ahead = max(made[n].back for _, n in steps), max(made[n].ahead for _, n in steps)
    if not back and not ahead:
        for step, name in steps:
            rows = rows.withColumn(name, F.expr(step.source))
        return rows
    width = max(block_steps, back + ahead) if block_steps == BLOCK_STEPS else block_steps
    laid = block_series(rows, _KEYS, _ROW, look_back=back, look_ahead=ahead, mode="placed", block_steps=width)
    for depth in range(1, 1 + max(made[n].depth for _, n in steps)):
        level = [(s, n) for s, n in steps if made[n].depth == depth]
        plain = {n: _near_column(laid, s) for s, n in level if s.kind != "order"}
        if plain:
            laid = laid.with_columns(plain)
        ordered = {n: WindowQuantile(s.source, *s.args) for s, n in level if s.kind == "order"}
        if ordered:
            laid = with_window_quantiles(laid, ordered)
    return laid.own_rows()


def _near_column(laid: BlockedSeries, step: Step) -> Column:
    if step.kind == "row":
        return F.expr(step.source)
    if step.kind == "lag":
        return laid.lag(step.source, *step.args)
    name, size, least, ahead = step.args
    aggregates = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    value = laid.over(aggregates[name](step.source), size, -ahead).cast("double")
    if name == "sum" and least == 0:
        value = F.coalesce(value, F.lit(0.0))
    held = laid.over(F.count(step.source), size, -ahead) >= least
    return F.when(held, F.nanvl(value, F.lit(None).cast("double")))


def _with_whole(rows: DataFrame, steps: list[tuple[Step, str]], made, block_steps: int) -> DataFrame:
    scans, ranks, singles = {}, {}, []
    for step, name in steps:
        if step.kind == "scan":
            kind, *rest = step.args
            scans[name] = Scan("ewm", step.source, keep=rest[0], mean=rest[1]) if kind == "ewm" else Scan(kind, step.source, *rest)
        elif step.kind in ("rank", "repeat"):
            ranks.setdefault(step.source, []).append((step, name))
        else:
            singles.append((step, name))
    if scans:
        rows = with_scans(rows, _KEYS, _ROW, scans, block_steps)
    if ranks:
        settled = settle(rows.sparkSession, rows, "rule-rows")
        rows = settled
        for source, wanted in ranks.items():
            used = set().union(*[made[n].columns for _, n in wanted])
            rows = _with_places(rows, settled, source, wanted, used)
    if singles:
        rows = _with_singles(rows, singles, made)
    return rows


def _with_places(rows: DataFrame, base: DataFrame, source: str, wanted, used: set[str]) -> DataFrame:
    mine = base.filter(F.col("_column").isin(sorted(used)))
    places = value_places(mine.select(*_KEYS, _ROW, source), _KEYS, source, _ROW)
    sized = any(step.kind == "rank" and (step.args[2] or not step.args[1]) for step, _ in wanted)
    if sized:
        places = settle(rows.sparkSession, places, "places")
        totals = places.groupBy(*_KEYS).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_all_kinds"))
        places = places.join(small_side(totals), list(_KEYS))
    columns = {}
    for step, name in wanted:
        if step.kind == "repeat":
            other = {"first": F.col(_ROW) != F.col("_first"), "last": F.col(_ROW) != F.col("_last")}
            columns[name] = other.get(step.args[0], F.col("_n") > 1)
            continue
        method, ascending, share = step.args
        low, n = F.col("_less"), F.col("_n")
        every, kinds = (F.col("_all"), F.col("_all_kinds")) if sized else (None, None)
        if not ascending:
            low = every - low - n
        dense = F.col("_kinds") + 1 if ascending else kinds - F.col("_kinds")
        rank = {"average": low + (n + 1) / 2, "min": low + 1, "max": low + n, "dense": dense}[method].cast("double")
        columns[name] = rank / (kinds if method == "dense" else every) if share else rank
    held = ["_n", "_first", "_last", "_less", "_kinds"] + (["_all", "_all_kinds"] if sized else [])
    # A value that many rows share is one row of the places; adaptive execution splits its rows.
    return rows.join(places, [*_KEYS, source], "left").withColumns(columns).drop(*held)


def _with_singles(rows: DataFrame, singles: list[tuple[Step, str]], made) -> DataFrame:
    used = set().union(*[made[n].columns for _, n in singles])
    mine = rows.filter(F.col("_column").isin(sorted(used)))
    simple = {
        "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "std_pop": F.stddev_pop, "var_pop": F.var_pop, "sum": F.sum,
        "min": F.min, "max": F.max, "count": F.count, "size": lambda c: F.count(F.lit(1)),
    }
    aggregates, others = [], []
    for step, name in singles:
        kind = step.args[0]
        if kind in simple:
            value = simple[kind](step.source).cast("double")
            value = F.coalesce(value, F.lit(0.0)) if kind == "sum" else F.nanvl(value, F.lit(None).cast("double"))
            aggregates.append(value.alias(name))
        elif kind == "nunique":
            different = mine.groupBy(*_KEYS, step.source).agg(F.lit(1).alias("_one"))
            others.append(different.groupBy(*_KEYS).agg(F.count(step.source).cast("double").alias(name)))
        else:
            q = 0.5 if kind == "median" else step.args[1]
            others.append(grouped_quantiles(mine, _KEYS, step.source, {name: q}).select(*_KEYS, name))
    tables = [mine.groupBy(*_KEYS).agg(*aggregates)] if aggregates else []
    for table in [*tables, *others]:
        rows = rows.join(small_side(table), list(_KEYS), "left")
    return rows
