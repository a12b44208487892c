"""Joins against small tables whose size is checked before broadcasting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.session import settle

BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Return ``df`` ready to be joined to a large table.

    It is computed once and stored in the shared folder, then counted there.
    Within the bound it is marked for broadcast, so the large side is not
    shuffled; beyond it the join shuffles and AQE splits skewed keys.
    """
    stored = settle(df.sparkSession, df, "small-side")
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored
