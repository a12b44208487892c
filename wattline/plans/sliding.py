"""Quantiles of sliding windows over blocked series.

A block and its halo are one array in a task, whose sorted runs answer all windows of the block; a row costs
the logarithm of the block and not the length of its window, and no window is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql.types import DoubleType, StructField, StructType

from wattline.functions.order_statistics import window_quantiles
from wattline.plans.blocks import _BLOCK, _POS, BlockedSeries


@dataclass(frozen=True)
class WindowQuantile:
    """Quantile ``q`` of the ``size`` values of ``source`` that end ``ahead`` rows on; null below ``least`` values."""

    source: str
    q: float
    size: int
    least: int
    ahead: int = 0


def with_window_quantiles(laid: BlockedSeries, wanted: dict[str, WindowQuantile]) -> BlockedSeries:
    """``laid`` with one column per wanted quantile. Windows of one source and size share their runs."""
    schema = StructType([*laid.df.schema.fields, *[StructField(n, DoubleType()) for n in wanted]])

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by(_POS)
        for name, w in wanted.items():
            values = table.column(w.source).to_numpy()
            (found,) = window_quantiles(values, w.size, w.ahead, [(w.q, w.least)])
            table = table.append_column(name, pa.array(found, from_pandas=True))
        return table

    return replace(laid, df=laid.df.groupBy(*laid.keys, _BLOCK).applyInArrow(block, schema))
