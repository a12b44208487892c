"""Document fingerprints by winnowing.

Rolling hashes of all runs of ``GRAM`` code points are taken; of every window of
``WINDOW`` consecutive hashes the smallest is kept, the rightmost of equal ones, with its position. Two texts
that share a run of ``GRAM + WINDOW - 1`` code points share a fingerprint.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from wattline.llm.batches import map_batches, slices
from wattline.llm.hashing import mix64

GRAM, WINDOW = 16, 16
#: Code points handled at once; longer texts are cut so that every window is in one part.
LIMIT = 1 << 23
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_NONE = np.uint64(2**64 - 1)

Prints = tuple[np.ndarray, np.ndarray]


def _rolling(codes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of GRAM codes from every place; runs of doubled length from two halves."""
    hashes = codes.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < GRAM:
        factor = np.uint64(pow(_BASE, size, 1 << 64))
        hashes = hashes[:-size] * factor + hashes[size:]
        size *= 2
    return mix64(hashes)


def _chosen(texts: list[str]) -> list[Prints]:
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    grams = np.maximum(lengths - GRAM + 1, 0)
    windows = np.maximum(grams - WINDOW + 1, 0)
    if grams.any():
        hashes = _rolling(codes)
        keys = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    places = np.zeros(0, np.int64)
    if windows.any():
        least, size = keys, 1
        while size < WINDOW:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        change = np.zeros(len(least) + 1, np.int8)
        full = windows > 0
        np.add.at(change, starts[full], 1)
        np.add.at(change, starts[full] + windows[full], -1)
        at = (_PLACE - (least[np.cumsum(change[:-1]) > 0] & _PLACE)).astype(np.int64)
        places = at[np.concatenate(([True], at[1:] != at[:-1]))]
    first = np.searchsorted(places, starts)
    last = np.searchsorted(places, starts + lengths)
    found = []
    for row, text in enumerate(texts):
        if windows[row]:
            at = places[first[row] : last[row]]
        elif grams[row]:
            part = keys[starts[row] : starts[row] + grams[row]]
            at = np.array([int(_PLACE - (part.min() & _PLACE))])
        elif text:
            whole = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
            found.append((np.frombuffer(whole, "<u8"), np.zeros(1, np.int64)))
            continue
        else:
            found.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        found.append((hashes[at], at - starts[row]))
    return found


def winnow(texts: list[str]) -> list[Prints]:
    """Hashes and positions of each text's fingerprints, by position.

    A text of fewer hashes than a window has one fingerprint, the smallest of all; a text
    shorter than a run has the hash of the whole text at position 0; an empty text has none.
    """
    found: list[Prints] = []
    batch: list[str] = []
    size = 0
    for text in texts:
        if size + len(text) > LIMIT and batch:
            found += _chosen(batch)
            batch, size = [], 0
        if len(text) <= LIMIT:
            batch.append(text)
            size += len(text)
            continue
        step = LIMIT - (GRAM + WINDOW - 2)
        hashes, places = [], []
        for at in range(0, len(text) - (GRAM + WINDOW - 2), step):
            part, where = _chosen([text[at : at + LIMIT]])[0]
            where = where + at
            fresh = where > (places[-1][-1] if places else -1)
            hashes.append(part[fresh])
            places.append(where[fresh])
        found.append((np.concatenate(hashes), np.concatenate(places)))
    return found + _chosen(batch) if batch else found


def digest(prints: Prints) -> str:
    """One string for all hashes and positions."""
    return hashlib.sha256(prints[0].astype("<u8").tobytes() + prints[1].astype("<u8").tobytes()).hexdigest()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes; 1 for two empty ones."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common / (len(one) + len(other) - common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes, positions of every row; null is the empty text. Rows are independent."""
    kind = dict(docs.dtypes)[id_col]

    def work(batch: pa.RecordBatch):
        found = winnow([text or "" for text in batch.column(1).to_pylist()])
        offsets = pa.array(np.cumsum([0] + [len(h) for h, _ in found]), pa.int32())
        hashes = np.concatenate([h for h, _ in found]).astype(np.uint64).view(np.int64)
        return [
            batch.column(0),
            pa.ListArray.from_arrays(offsets, pa.array(hashes)),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([p for _, p in found]).astype(np.int64))),
        ]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, work, f"doc_id {kind}, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, part, extra for all rows in runs: rows of one ``part`` come in one task, in order, and the
    last is followed by a copy (``extra``) of the row that comes next in the order of all rows.

    The order is by id, null first, then by a hash of the text, and is circular. Parts lie
    between quantiles of the ids, so one task never orders all rows; only the first row of a part travels twice.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    steps = [i / parts for i in range(1, parts)] or [1.0]
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("doc_id", steps, 10_000)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        given = ids.notna()
        found = np.zeros(len(ids), np.int32)
        found[given] = np.searchsorted(bounds, ids[given].astype(np.int64), side="right")
        return pd.Series(found)

    placed = rows.withColumn("own", part_of("doc_id"))
    heads = sorted(
        (r.own, r.head.doc_id, r.head.tie)
        for r in placed.groupBy("own").agg(F.min(F.struct("doc_id", "tie")).alias("head")).collect()
    )
    before = {own: heads[i - 1][0] for i, (own, _, _) in enumerate(heads)}
    values = ", ".join(
        f"({own}, {'cast(null as bigint)' if i is None else f'{i}L'}, {before[own]}, {tie}L)" for own, i, tie in heads
    )
    if not heads:
        return placed.select("doc_id", "text", F.col("own").alias("part"), F.lit(False).alias("extra"))
    lead = spark.sql(f"select * from values {values} h(own, head_id, previous, head_tie)")
    targets = F.when(
        F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")),
        F.array(
            F.struct(F.col("own").alias("part"), F.lit(False).alias("extra")),
            F.struct(F.col("previous").alias("part"), F.lit(True).alias("extra")),
        ),
    ).otherwise(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("extra"))))
    return (
        placed.join(F.broadcast(lead), "own")
        .select("doc_id", "text", "tie", F.explode(targets).alias("to"))
        .select("doc_id", "text", "tie", "to.part", "to.extra")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "extra", "doc_id", "tie")
        .select("doc_id", "text", "part", "extra")
    )


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_fingerprints long"
)


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_fingerprints:
    the edited text ends with the beginning of the next row's text, in the circular order of ``with_next``. Null
    is the empty text; a single row is its own next; repeated rows are rows of their own; an empty table gives none.
    """
    wanted = _parse_datatype_string(_SCHEMA)
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, of which the next is not yet seen
        for batch in batches:
            for slice_ in slices(batch, 1):
                ids, texts, parts, extras = (slice_.column(i).to_pylist() for i in range(4))
                prints = winnow(texts)
                pairs = []
                for i, text, part, extra, found in zip(ids, texts, parts, extras, prints):
                    row = (i, text, part, found, np.unique(found[0]))
                    if held is not None and held[2] == part:
                        pairs.append((held, row))
                    held = None if extra else row
                changed = [edited(a[1], b[1]) for a, b in pairs]
                rows = []
                for (a, b), new, found in zip(pairs, changed, winnow(changed)):
                    rows.append(
                        (
                            a[0],
                            len(a[1]),
                            hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(),
                            digest(a[3]),
                            digest(found),
                            likeness(a[4], np.unique(found[0])),
                            likeness(a[4], b[4]),
                            len(a[3][0]),
                        )
                    )
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
                    )

    return with_next(docs, id_col, text_col).mapInArrow(run, wanted)
