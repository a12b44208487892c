"""Ordered computations over long series without one task per series.

A window partitioned by series alone puts a whole series into one task. Here
the rows of a series get a position, positions are cut into blocks, and every
row is copied into the following blocks that look back to it (its halo). The
window is then partitioned by (series, block), and halo copies are dropped
afterwards, so a series that holds a third of all rows spreads over many tasks.

Two kinds of position exist:

``row``   0, 1, 2 … in time order; "24 back" means 24 rows back.
``time``  microseconds since the epoch; "24 back" means exactly 24 steps back.

A third mode, ``placed``, takes row numbers that a column already holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.config import HOUR_MICROS
from wattline.plans.sizes import small_side

BLOCK_STEPS = 8192

_POS, _BLOCK, _BUCKET, _BEFORE = "_pos", "_block", "_bucket", "_before"


def micros(ts: str | Column) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Integer division rounding down, also before the epoch."""
    divisor = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, divisor), divisor)


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    span_micros: int,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Add the dense row number of each row within its series.

    Rows are numbered inside time buckets; the rows in all earlier buckets come
    from one count per bucket, so only the counts are ordered per series.
    """
    bucketed = df.withColumn(_BUCKET, floor_div(micros(ts), span_micros))
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        bucketed.groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, _BUCKET, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(_BEFORE))
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(ts, *tiebreak)
    return (
        bucketed.join(before.hint("shuffle_hash"), [*keys, _BUCKET])
        .withColumn(_POS, F.col(_BEFORE) + F.row_number().over(inside) - 1)
        .drop(_BUCKET, _BEFORE)
    )


@dataclass(frozen=True)
class BlockedSeries:
    """Rows laid out in (series, block) partitions with their look-back halo."""

    df: DataFrame
    keys: tuple[str, ...]
    mode: str
    step: int

    def _window(self):
        return Window.partitionBy(*self.keys, _BLOCK).orderBy(_POS)

    def _frame(self, first: int, last: int):
        if self.mode != "time":
            return self._window().rowsBetween(first, last)
        return self._window().rangeBetween(first * self.step, last * self.step)

    def lag(self, col: str | Column, k: int) -> Column:
        if k == 0:
            return F.col(col) if isinstance(col, str) else col
        if self.mode != "time":
            return F.lag(col, k).over(self._window())
        return F.max(col).over(self._frame(-k, -k))

    def over(self, aggregate: Column, size: int, shift: int = 0) -> Column:
        """``aggregate`` over the ``size`` positions that end ``shift`` back."""
        return aggregate.over(self._frame(-(size - 1) - shift, -shift))

    def full(self, aggregate: Column, col: str, size: int, shift: int = 0) -> Column:
        """As ``over``, but null unless all ``size`` values are present."""
        return F.when(self.over(F.count(col), size, shift) == size, self.over(aggregate, size, shift))

    def joint(self, value: Column, *columns: str) -> Column:
        """``value``, which reads ``columns`` of the same row."""
        return value

    def whole_windows(self, col: str, wanted: dict[str, tuple[str, int, int]]) -> BlockedSeries:
        """Columns by name for (``sum``, ``mean``, ``std``, ``min`` or ``max``; size; shift) over windows that hold all their values.

        Windows of doubled sizes are put together from two of half the size, and any size from doubled ones, so a row costs
        the logarithm of the size and nothing is taken off again: sums add up, squared deviations add up with those of the
        parts' means, and extremes may overlap. A window that lacks a row or a value gives null.
        """
        sizes = {size for _, size, _ in wanted.values()}
        if min(sizes) < 1:
            raise ValueError("a window holds at least one row")
        needs = {kind for kind, _, _ in wanted.values()}
        sums, squares = needs & {"sum", "mean", "std"}, "std" in needs
        extremes = sorted(needs & {"min", "max"})
        levels = max(sizes).bit_length()
        first = {f"_{e}0": F.col(col) for e in extremes}
        if sums:
            first["_sum0"] = F.col(col).cast("double")
        if squares:
            first["_dev0"] = F.when(F.col(col).isNotNull(), F.lit(0.0))
        laid = self.with_columns(first)
        for k in range(1, levels):
            half = 1 << (k - 1)
            columns = {}
            for e in extremes:
                now, before = F.col(f"_{e}{k - 1}"), laid.lag(f"_{e}{k - 1}", half)
                columns[f"_{e}{k}"] = F.when(now.isNotNull() & before.isNotNull(), (F.least if e == "min" else F.greatest)(now, before))
            if sums:
                now, before = F.col(f"_sum{k - 1}"), laid.lag(f"_sum{k - 1}", half)
                columns[f"_sum{k}"] = now + before
                if squares:
                    gap = now - before
                    columns[f"_dev{k}"] = F.col(f"_dev{k - 1}") + laid.lag(f"_dev{k - 1}", half) + gap * gap / (2 * half)
            laid = laid.with_columns(columns)
        done = {name: laid._whole(*what) for name, what in wanted.items()}
        helpers = [f"{part}{k}" for part in ("_sum", "_dev", "_min", "_max") for k in range(levels)]
        return laid.with_columns(done).drop(*helpers)

    def _whole(self, kind: str, size: int, shift: int) -> Column:
        top = size.bit_length() - 1
        if kind in ("min", "max"):
            ends = [self.lag(f"_{kind}{top}", shift + back) for back in sorted({0, size - (1 << top)})]
            both = (F.least if kind == "min" else F.greatest)(ends[0], ends[-1]) if len(ends) == 2 else ends[0]
            return F.when(ends[0].isNotNull() & ends[-1].isNotNull(), both)
        total = deviation = None
        held = 0
        for k in range(top + 1):
            if not size >> k & 1:
                continue
            part = self.lag(f"_sum{k}", shift + held)
            if kind == "std":
                squares = self.lag(f"_dev{k}", shift + held)
                if total is not None:
                    gap = part / (1 << k) - total / held
                    squares = deviation + squares + gap * gap * (held * (1 << k) / (held + (1 << k)))
                deviation = squares
            total = part if total is None else total + part
            held += 1 << k
        if kind == "std":
            return F.sqrt(deviation / (size - 1)) if size > 1 else F.lit(None).cast("double")
        return total / size if kind == "mean" else total

    def running(self, aggregate: Column) -> Column:
        """``aggregate`` from the start of the block's halo to each row."""
        return aggregate.over(self._window().rowsBetween(Window.unboundedPreceding, 0))

    def drop(self, *columns: str) -> BlockedSeries:
        return replace(self, df=self.df.drop(*columns))

    def with_columns(self, columns: dict[str, Column]) -> BlockedSeries:
        return replace(self, df=self.df.withColumns(columns))

    def own_rows(self) -> DataFrame:
        """Drop halo copies and helper columns."""
        return self.df.filter(F.col("_own")).drop(_POS, _BLOCK, "_own")


def block_series(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    look_back: int,
    mode: str = "row",
    step_micros: int = HOUR_MICROS,
    block_steps: int = BLOCK_STEPS,
    tiebreak: Sequence[str] = (),
    look_ahead: int = 0,
) -> BlockedSeries:
    """Lay ``df`` out in blocks of ``block_steps`` positions.

    ``look_back`` is the farthest position any later window reaches back to, and
    ``look_ahead`` the farthest it reaches ahead. A block smaller than these is
    allowed; a row is then copied into more than one other block. With
    ``mode="placed"``, ``ts`` is a column of row numbers without gaps.
    """
    if mode == "row":
        placed = row_positions(df, keys, ts, span_micros=block_steps * step_micros, tiebreak=tiebreak)
        unit = 1
    elif mode == "placed":
        placed = df.withColumn(_POS, F.col(ts))
        unit = 1
    elif mode == "time":
        placed = df.withColumn(_POS, micros(ts))
        unit = step_micros
    else:
        raise ValueError(f"mode must be 'row', 'placed' or 'time', not {mode!r}")
    width = block_steps * unit
    own_block = floor_div(F.col(_POS), width)
    last_block = floor_div(F.col(_POS) + F.lit(look_back * unit), width)
    first_block = floor_div(F.col(_POS) - F.lit(look_ahead * unit), width) if look_ahead else F.col("_home")
    spread = (
        placed.withColumn("_home", own_block)
        .withColumn(_BLOCK, F.explode(F.sequence(first_block, last_block)))
        .withColumn("_own", F.col(_BLOCK) == F.col("_home"))
        .drop("_home")
    )
    return BlockedSeries(spread, tuple(keys), mode, unit)


def edge_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    n: int,
    *,
    last: bool,
    span_micros: int = 720 * HOUR_MICROS,
    rank: str | None = None,
) -> DataFrame:
    """First or last ``n`` rows of every series.

    One count per time bucket tells where the n-th row lies. Only rows on the
    wanted side of that bucket are sorted, so the bulk of a long series is
    dropped by a filter and never ordered.
    """
    bucketed = df.withColumn(_BUCKET, floor_div(micros(ts), span_micros))
    direction = F.col(_BUCKET).desc() if last else F.col(_BUCKET).asc()
    nearer = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        bucketed.groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_nearer", F.coalesce(F.sum("_n").over(nearer), F.lit(0)))
        .filter(F.col("_nearer") < n)
        .groupBy(*keys)
        .agg((F.min(_BUCKET) if last else F.max(_BUCKET)).alias("_cut"))
    )
    side = F.col(_BUCKET) >= F.col("_cut") if last else F.col(_BUCKET) <= F.col("_cut")
    order = F.col(ts).desc() if last else F.col(ts).asc()
    rank_col = rank or "_rank"
    kept = (
        bucketed.join(small_side(cut), list(keys))
        .filter(side)
        .withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        .filter(F.col(rank_col) <= n)
        .drop(_BUCKET, "_cut")
    )
    return kept if rank else kept.drop("_rank")
