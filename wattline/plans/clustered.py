"""Market table that is stored in blocks, so that ordered operators need no exchange.

Rows are laid out once as ``plans.blocks`` does it for every operator: by zone and time block, with the halo
that later windows look back to. The table is bucketed and sorted by (zone, block), and Spark reads a bucket as one
partition of that layout: windows over a block find their rows together. Lags, rolling statistics, filling and
the seasonal naive forecast then run without a shuffle, as often as they are needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wattline.config import HOUR_MICROS, TS, ZONE
from wattline.plans.blocks import _BLOCK, _POS, BLOCK_STEPS, BlockedSeries, block_series
from wattline.session import scratch_path

#: Rows of a bucket, without halos, from which on there are more buckets; and what Spark allows of them.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 100_000


def store(
    df: DataFrame,
    *,
    look_back: int,
    path: str | None = None,
    name: str | None = None,
    buckets: int = 64,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    step_micros: int = HOUR_MICROS,
    block_steps: int = BLOCK_STEPS,
) -> str:
    """Write ``df`` by time blocks with a halo of ``look_back`` steps, and return the name of the table.

    It has ``buckets`` buckets at least, and more where one would hold over ``BUCKET_ROWS`` rows: a bucket is sorted and read by one
    task. The rows of ``df`` are counted for this.

    ``path`` is a folder that all executors share (by default one below the checkpoint folder). A lag is exactly so many steps
    of time; see ``block_series`` for ``mode="time"``.
    """
    laid = block_series(df, keys, ts, look_back=look_back, mode="time", step_micros=step_micros, block_steps=block_steps)
    name = name or f"blocks_{uuid.uuid4().hex}"
    by = [*keys, _BLOCK]
    buckets = min(max(buckets, -(-df.count() // BUCKET_ROWS)), MOST_BUCKETS)
    # One task writes a bucket, so that a bucket is one file.
    rows = laid.df.repartition(buckets, *by)
    writer = rows.write.bucketBy(buckets, *by).sortBy(*by, _POS).format("parquet")
    writer.option("path", path or scratch_path(df.sparkSession, "clustered")).saveAsTable(name)
    return name


def load(spark: SparkSession, name: str, *, keys: Sequence[str] = (ZONE,), step_micros: int = HOUR_MICROS) -> BlockedSeries:
    """The stored layout, ready for windows; filters on the rows' own columns keep its order."""
    return BlockedSeries(spark.table(name), tuple(keys), "time", step_micros)
