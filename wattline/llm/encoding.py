"""SentencePiece encoding of a table of texts, one Arrow slice at a time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.batches import map_batches
from wattline.llm.pieces import PieceModel


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_texts(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """doc_id, ids, spans, decoded and the columns ``keep`` for every row of ``docs``; ``model`` is a file that every executor has.

    ``ids`` are little-endian unsigned 32-bit numbers, with begin and end ids; ``spans`` holds
    the first and the last-plus-one byte of each of them in the UTF-8 source, in the same form;
    ``decoded`` is what the ids decode to. Null is the empty text, which has the begin and the
    end id alone. Rows are independent: repeated rows repeat, an empty table gives none, ids may
    be null. A text longer than a slice is encoded alone, whole. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch):
        texts = [text or "" for text in batch.column(1).to_pylist()]
        ids, spans, decoded = zip(*_model(model).encode_all(texts))
        return [
            batch.column(0),
            pa.array([i.tobytes() for i in ids], pa.binary()),
            pa.array([s.tobytes() for s in spans], pa.binary()),
            pa.array(decoded, pa.string()),
            *batch.columns[2:],
        ]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    kept = "".join(f", {name} {dict(docs.dtypes)[name]}" for name in keep)
    return map_batches(rows, work, f"doc_id {kind}, ids binary, spans binary, decoded string{kept}")


def encoded_digests(docs: DataFrame, model: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 and the columns ``keep``: the encoding in a form that can be compared."""
    return encode_texts(docs, model, keep=keep).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"),
        *keep,
    )
