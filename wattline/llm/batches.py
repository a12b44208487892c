"""Arrow batches of texts in Python workers, cut so that memory stays bounded."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of text that a worker handles at once; a longer text comes alone.
TEXT_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, text_index: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch``, in order, of at most ``limit`` text bytes or one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_pylist()
    first = total = 0
    for row, size in enumerate(sizes):
        if total + size > limit and row > first:
            yield batch.slice(first, row - first)
            first, total = row, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def give_back() -> None:
    """Return freed memory of this worker to the system, as workers are reused by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library that has no such call
        pass


def map_batches(
    rows: DataFrame,
    work: Callable[[pa.RecordBatch], Sequence[pa.Array | list] | None],
    schema: str,
    text_index: int = 1,
    limit: int = TEXT_BYTES,
) -> DataFrame:
    """``work`` on slices of ``rows``; it returns one array or list per column of ``schema``, or None for no rows."""
    wanted: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_index, limit):
                columns = work(part)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, field.type)
                            for column, field in zip(columns, arrow)
                        ],
                        schema=arrow,
                    )
        give_back()

    return rows.mapInArrow(run, wanted)
