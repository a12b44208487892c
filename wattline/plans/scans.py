"""Running values from the start of a series, in blocks that hand on a carry.

An associative scan in two passes: each block scans its own rows; one total per block and series is scanned in turn,
and the total of all earlier blocks, the carry, is combined with every row of the block. Only totals are
ordered per series, one for ``block_steps`` rows, so no task holds a series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wattline.plans.blocks import BLOCK_STEPS, floor_div

_BLOCK = "_scan_block"
#: Places that one matrix product of a linear recurrence covers.
_CHUNK = 64


@dataclass(frozen=True)
class Scan:
    """One running value: ``sum``, ``min``, ``max`` or ``count`` of ``source`` from the first row to each row.

    With ``gaps`` a row whose own value is missing gets none. ``keep`` makes it the linear recurrence
    ``y = keep * y_before + x`` instead, divided by that of ones where ``mean`` (weights that fade by ``keep`` a row), else started at the
    first value and fed ``(1 - keep) * x``. The recurrence takes no missing values.
    """

    kind: str
    source: str
    gaps: bool = False
    keep: float = 0.0
    mean: bool = True


def faded(values: np.ndarray, keep: float) -> np.ndarray:
    """``y[t] = keep * y[t - 1] + values[t]`` from ``y[-1] = 0``, a matrix product for each chunk of places."""
    places = np.arange(_CHUNK)
    gap = places[:, None] - places[None, :]
    weights = np.where(gap >= 0, np.power(keep, np.maximum(gap, 0), dtype=np.float64), 0.0)
    padded = np.zeros(-(-len(values) // _CHUNK) * _CHUNK)
    padded[: len(values)] = values
    local = padded.reshape(-1, _CHUNK) @ weights.T
    carry, whole = 0.0, keep**_CHUNK
    starts = np.empty(len(local))
    for i, end in enumerate(local[:, -1].tolist()):
        starts[i] = carry
        carry = whole * carry + end
    return (local + starts[:, None] * np.power(keep, places + 1.0)[None, :]).ravel()[: len(values)]


def with_scans(
    rows: DataFrame, keys: Sequence[str], position: str, scans: dict[str, Scan], block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """``rows`` with one column per scan, in the order of ``position`` (0, 1, 2 … without gaps in each series)."""
    plain = {name: s for name, s in scans.items() if s.kind != "ewm"}
    fading = {name: s for name, s in scans.items() if s.kind == "ewm"}
    blocked = rows.withColumn(_BLOCK, floor_div(F.col(position), block_steps))
    if fading:
        blocked = _fade(blocked, keys, position, fading, block_steps)
    if plain:
        blocked = _accumulate(blocked, keys, position, plain)
    return blocked.drop(_BLOCK)


def _aggregate(scan: Scan, column: str | Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[scan.kind](column)


def _combined(scan: Scan, before: Column, now: Column) -> Column:
    if scan.kind in ("sum", "count"):
        return F.coalesce(before + now, before, now)
    return (F.least if scan.kind == "min" else F.greatest)(before, now)


def _carries(totals: DataFrame, keys: Sequence[str], scans: dict[str, Scan]) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    over = {}
    for name, scan in scans.items():
        later = F.sum if scan.kind in ("sum", "count") else F.min if scan.kind == "min" else F.max
        over[f"_carry{name}"] = later(f"_total{name}").over(earlier)
    return totals.select(*keys, _BLOCK, *[c.alias(n) for n, c in over.items()])


def _accumulate(blocked: DataFrame, keys: Sequence[str], position: str, scans: dict[str, Scan]) -> DataFrame:
    totals = blocked.groupBy(*keys, _BLOCK).agg(*[_aggregate(s, s.source).alias(f"_total{n}") for n, s in scans.items()])
    upto = Window.partitionBy(*keys, _BLOCK).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumns({f"_local{n}": _aggregate(s, s.source).over(upto) for n, s in scans.items()})
    joined = local.join(_carries(totals, keys, scans).hint("shuffle_hash"), [*keys, _BLOCK])
    columns = {}
    for name, scan in scans.items():
        value = _combined(scan, F.col(f"_carry{name}"), F.col(f"_local{name}"))
        columns[name] = F.when(F.col(scan.source).isNotNull(), value) if scan.gaps else value
    dropped = [f"{part}{n}" for n in scans for part in ("_local", "_carry")]
    return joined.withColumns({n: c.cast("double") for n, c in columns.items()}).drop(*dropped)


def _fade(
    blocked: DataFrame, keys: Sequence[str], position: str, scans: dict[str, Scan], block_steps: int
) -> DataFrame:
    """The recurrences: local values of each block, carries of the blocks, and both put together.

    A carry is a pair: what a block makes of nothing, and the factor by which it fades what comes before it. The factor
    follows from the number of rows, and only blocks of one row per ``block_steps`` rows meet in a series.
    """
    schema = StructType([*blocked.schema.fields, *[StructField(f"_local{n}", DoubleType()) for n in scans]])

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by(position)
        for name, scan in scans.items():
            values = table.column(scan.source).to_numpy()
            if not scan.mean:
                starts = table.column(position).to_numpy() == 0
                values = np.where(starts, values, values * (1 - scan.keep))
            table = table.append_column(f"_local{name}", pa.array(faded(values, scan.keep)))
        return table

    scanned = blocked.groupBy(*keys, _BLOCK).applyInArrow(local, schema)
    ends = scanned.groupBy(*keys, _BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max_by(f"_local{n}", position).alias(f"_total{n}") for n in scans]
    )
    names = [f"_carry{n}" for n in scans]
    held = StructType([*[f for f in blocked.schema.fields if f.name in (*keys, _BLOCK)], *[StructField(n, DoubleType()) for n in names]])

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by(_BLOCK)
        rows = table.column("_rows").to_pylist()
        columns = [table.column(f.name) for f in held.fields[: -len(names)]]
        for name, scan in scans.items():
            before, found = 0.0, []
            for total, n in zip(table.column(f"_total{name}").to_pylist(), rows):
                found.append(before)
                before = before * scan.keep**n + total
            columns.append(pa.array(found, pa.float64()))
        return pa.table(columns, names=[f.name for f in held.fields])

    carries = ends.groupBy(*keys).applyInArrow(carry, held)
    joined = scanned.join(carries.hint("shuffle_hash"), [*keys, _BLOCK])
    inside = F.pmod(F.col(position), F.lit(block_steps).cast("bigint")) + 1
    columns = {}
    for name, scan in scans.items():
        value = F.col(f"_local{name}") + F.col(f"_carry{name}") * F.pow(F.lit(scan.keep), inside)
        if scan.mean and scan.keep > 0:
            ones = -F.expm1((F.col(position) + 1) * math.log(scan.keep)) / (1 - scan.keep)
            value = value / ones
        columns[name] = value
    return joined.withColumns(columns).drop(*names, *[f"_local{n}" for n in scans])
