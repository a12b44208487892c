"""Leakage guard: how near the newest value that enters a feature is to the row it is a feature of.

The features are computed a second time from a table in which each measure is replaced by its own time. A lag then
gives the time of the row it read; every aggregate of a window, and every sum over columns, gives the newest time
among what it read; filling carries the time of the value it filled in. So what a feature holds is the newest source time
behind it, whichever way the feature is put together from lags, windows, fills and sums.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from wattline.config import TS, ZONE
from wattline.operators.features import FeatureSpec, feature_columns, lay_out, neighbour_features
from wattline.plans.blocks import BLOCK_STEPS, BlockedSeries, micros


@dataclass(frozen=True)
class SourceTimes(BlockedSeries):
    """A block layout whose measures are times: what reads several of them returns the newest."""

    def full(self, aggregate: Column, col: str, size: int, shift: int = 0) -> Column:
        return super().full(F.max(col), col, size, shift)

    def whole_windows(self, col: str, wanted: dict[str, tuple[str, int, int]]) -> BlockedSeries:
        return super().whole_windows(col, {name: ("max", size, shift) for name, (_, size, shift) in wanted.items()})

    def joint(self, value: Column, *columns: str) -> Column:
        """The newest time of ``columns``, null only where ``value`` is."""
        newest = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
        return F.when(value.isNotNull(), newest)


def source_times(
    df: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    build: Callable[[BlockedSeries, FeatureSpec], BlockedSeries] = neighbour_features,
    *,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    lag_mode: str = "row",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """keys, time and, for each feature that ``build`` adds, the time (microseconds) of the newest value behind it."""
    measures = [spec.price, *spec.present(df)]
    time = micros(ts).cast("double")
    times = df.select(*keys, ts, *[F.when(F.col(c).isNotNull(), time).alias(c) for c in measures])
    laid = lay_out(times, spec, ts=ts, keys=keys, lag_mode=lag_mode, block_steps=block_steps)
    traced = SourceTimes(**{f.name: getattr(laid, f.name) for f in fields(laid)})
    return build(traced, spec).own_rows()


def leakage_report(
    df: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    build: Callable[[BlockedSeries, FeatureSpec], BlockedSeries] = neighbour_features,
    *,
    min_gap_steps: int | None = None,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    lag_mode: str = "row",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """feature, n_rows, least_gap_steps, n_leaks: one row per feature that reads other rows.

    ``least_gap_steps`` is the smallest distance between a row and the newest value behind its feature, in steps of the series, null
    if the feature is never there; ``n_leaks`` counts the rows where it is below ``min_gap_steps`` (the spec's ``min_lag``).
    ``build`` must use the layout's ``lag``, ``over``, ``full``, ``whole_windows`` and ``joint`` for what it reads.
    """
    least = spec.min_lag if min_gap_steps is None else min_gap_steps
    traced = source_times(df, spec, build, ts=ts, keys=keys, lag_mode=lag_mode, block_steps=block_steps)
    names = feature_columns(traced.columns, spec, keys, ts)
    gap = {c: (micros(ts) - F.col(c)) / spec.step_micros for c in names}
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.count(gap[c]).alias("n_rows"),
            F.min(gap[c]).alias("least_gap_steps"),
            F.count_if(gap[c] < least).alias("n_leaks"),
        )
        for c in names
    ]
    return traced.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
