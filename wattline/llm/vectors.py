"""Vectors on an integer grid, as Spark rows and as arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Numbers up to this size are exact as doubles, and as single floats.
EXACT, EXACT_SINGLE = 1 << 53, 1 << 24


def grid_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str | None = None, scale: int = 256) -> DataFrame:
    """vec_id, (label,) x for the rows that take part; ``x`` holds ``floor(scale * entry)`` as whole numbers.

    Rows with a null vector, an empty one, or a null or non-finite entry take no part, nor do rows whose
    vector has another length than most (of equally frequent lengths the longest counts).
    """
    entry_ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    numbers = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    kept = [F.col(id_col).alias("vec_id"), *([F.col(label_col).alias("label")] if label_col else [])]
    vectors = (
        rows.select(*kept, numbers.alias("entries"))
        .where(F.col("entries").isNotNull() & (F.size("entries") > 0) & F.forall("entries", entry_ok))
        .withColumn("x", F.transform("entries", lambda c: F.floor(c * scale)))
        .drop("entries")
    )
    lengths = vectors.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    return vectors.where(F.size("x") == (most[0]["length"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def packed(x: np.ndarray, entry: np.dtype) -> pa.Array:
    """The rows of a matrix as binary values with entries of the kind ``entry``."""
    data = np.ascontiguousarray(x.astype(entry))
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(entry.itemsize * x.shape[1] if len(x) else 0)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(column: pa.ChunkedArray, entry: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), entry).reshape(len(column), -1)
