"""Joins against tables of ids whose size is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Ids that may be broadcast, of up to some 100 bytes each; a larger side is shuffled.
BROADCAST_IDS = 500_000


def by_ids(ids: DataFrame) -> DataFrame:
    """``ids``, a stored table, for a semi or anti join: broadcast within the bound, else shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
