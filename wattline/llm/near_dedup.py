"""Near-duplicate detection: fast similarity sketches, banding and exact verification.

Every document's set of word shingles is hashed to 64 bits. Its sketch is filled in rounds:
in round i each element goes to one bin, with a value that starts with i, and a bin keeps its
smallest value; rounds end as soon as every bin is filled. After as many rounds as bins, round
``bins + j`` sends all elements to bin j, so every coordinate is filled after twice that many.
Two sketches agree in a coordinate with the sets' Jaccard similarity as probability, with
concentration as for independent hashes.

Bands of ``rows`` coordinates are the candidate keys: a pair at 0.75 shares none of 32 bands
of 4 with probability 5e-6, a pair at 0.8 with 5e-8. Documents with equal sets are one class.
A key's classes are first compared with the smallest of them only; linked classes get the
label of their component. Classes of keys that then still have several components are compared
across components, where the prefixes of their sets allow a link: first with a few classes that are nearest to what their
group has in common, then, where components are still apart, with all. So a group of thousands of near copies
costs a few comparisons per member, while every pair that shares a key is compared, known to be
connected, or proven to be no link. Comparisons use the whole sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.batches import map_batches
from wattline.llm.graphs import components
from wattline.llm.hashing import mix64, shingles, word_hashes
from wattline.llm.joins import by_ids
from wattline.llm.linking import joined_components, prefixes_of
from wattline.session import settle

WIDTH, BANDS, ROWS = 5, 32, 4
#: Bytes of text that a worker hashes at once; the arrays of a slice take some 60 times as much.
SLICE_BYTES = 1 << 18
#: What sizes of linked sets meet.
ALIKE = "100 * least(n, other_n) >= 75 * greatest(n, other_n)"


def sketch(elements: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Sketches, one row of ``bins`` numbers per set; ``elements`` holds the sets in turn. Empty sets stay unfilled."""
    empty = np.uint64(2**64 - 1)
    filled = np.full((len(counts), bins), empty)
    flat = filled.reshape(-1)
    owner = np.repeat(np.arange(len(counts)), counts)
    for round_ in range(2 * bins):
        if not len(elements):
            break
        x = mix64(elements + np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = (np.uint64(round_) << np.uint64(48)) | (x & np.uint64((1 << 48) - 1))
        if round_ < bins:
            bin_ = ((x >> np.uint64(48)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64)
        else:
            bin_ = round_ - bins
        np.minimum.at(flat, owner * bins + bin_, value)
        open_ = (filled == empty).any(axis=1)[owner]
        elements, owner = elements[open_], owner[open_]
    return filled


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands of each sketch, different for different bands."""
    total = np.zeros((len(sketches), sketches.shape[1] // rows), np.uint64)
    for k in range(rows):
        total += mix64(sketches[:, k::rows] + np.uint64(k)) * (mix64(np.array([k + 1], np.uint64)) | np.uint64(1))
    return mix64(total + np.arange(total.shape[1], dtype=np.uint64))


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    found, numbers = shingles(*word_hashes([(t or "").encode() for t in texts]), WIDTH)
    ends = np.cumsum(numbers)
    return [np.unique(found[end - n : end]) for end, n in zip(ends, numbers)]


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sets as two signed numbers each."""
    raw = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _sketched(docs: DataFrame, kind: str) -> DataFrame:
    def work(batch: pa.RecordBatch):
        sets = _sets(batch.column(1).to_pylist())
        counts = np.array([len(s) for s in sets])
        digests = _digests(sets)
        keys = bands(sketch(np.concatenate(sets), counts, BANDS * ROWS)).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(np.where(counts > 0, BANDS, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].reshape(-1)))
        return [batch.column(0), pa.array(counts), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists]

    return map_batches(docs, work, f"doc_id {kind}, n_shingles long, hi long, lo long, bands array<long>", limit=SLICE_BYTES)


def _with_sets(docs: DataFrame, kind: str) -> DataFrame:
    def work(batch: pa.RecordBatch):
        sets = _sets(batch.column(1).to_pylist())
        digests = _digests(sets)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).astype(np.int64)))
        return [batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists]

    return map_batches(docs, work, f"doc_id {kind}, hi long, lo long, shingles array<long>", limit=SLICE_BYTES)


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets (class_id, n, shingles) have 100 x intersection >= 75 x union."""
    spark = sets.sparkSession
    sides = sets.select("class_id", "shingles")
    both = pairs.join(sides.toDF("b", "set_b"), "b").join(sides.toDF("a", "set_a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return settle(spark, counted.where("100 * common >= 75 * (total - common)").select("a", "b"), "links")


def _joined(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Components of ``rest`` (class_id, component) that links between them join, each with the smallest it reaches.

    A link of sets of n and m elements has at least 3 (n + m) / 7 in common, so as many stand in both
    from the first common element on. Sets with few rare elements before a common one are near what their group has in common, and are
    compared first.
    """
    elements = rest.join(sets, "class_id").select(
        F.col("class_id").alias("node"), "component", "n", F.explode("shingles").alias("element")
    )
    early = "28 * (n - at) >= 12 * n + 3 * greatest(4 * smallest, 3 * n)"
    allowed = f"{ALIKE} and 7 * least(n - at, other_n - other_at) >= 3 * (n + other_n)"
    return joined_components(prefixes_of(elements, early), allowed, lambda pairs: _verified(sets, pairs), ("at",))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than space and tab to carriage return, with A-Z in
    lower case; the set holds the distinct shingles of five words, or the whole sequence of a shorter text.
    Null, empty and blank texts have no shingle and are linked with nothing, nor is a null id, whose
    component_id is null and which is kept. Rows that repeat an id are one document; if their
    texts differ, the set with the smallest digest counts. ``component_id`` is the smallest id that
    links reach. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = settle(spark, _sketched(rows, kind), "sketches")
    one = (
        sketched.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.struct("hi", "lo", "n_shingles")).alias("set"))
        .select("doc_id", "set.*")
    )
    grouped = one.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("class_id"))
    members = settle(spark, one.join(grouped, ["hi", "lo"], "left"), "members")
    classes = members.where("doc_id = class_id").select("class_id", "hi", "lo", "n_shingles")
    keyed = (
        sketched.withColumnRenamed("doc_id", "class_id")
        .join(classes, ["class_id", "hi", "lo", "n_shingles"])
        .select("class_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    )
    buckets = keyed.groupBy("key").agg(F.min("class_id").alias("leader"), F.max("class_id").alias("last"))
    shared = settle(
        spark, keyed.join(buckets.where("leader != last"), "key").select("key", "class_id", "n", "leader"), "shared"
    )
    nodes = settle(spark, shared.select("class_id").distinct(), "candidates")
    wanted = rows.join(by_ids(nodes.toDF("doc_id")), "doc_id", "left_semi")
    sets = settle(
        spark,
        _with_sets(wanted, kind)
        .withColumnRenamed("doc_id", "class_id")
        .join(classes, ["class_id", "hi", "lo"])
        .dropDuplicates(["class_id"])
        .select("class_id", F.col("n_shingles").alias("n"), "shingles"),
        "sets",
    )
    sizes = classes.select(F.col("class_id").alias("leader"), F.col("n_shingles").alias("other_n"))
    stars = (
        shared.where("class_id != leader")
        .select("leader", "class_id", "n")
        .distinct()
        .join(sizes, "leader")
        .where(ALIKE)
        .select(F.col("leader").alias("a"), F.col("class_id").alias("b"))
    )
    links = _verified(sets, stars)
    labels = components(links)
    labelled = settle(
        spark,
        shared.join(labels.toDF("class_id", "component"), "class_id", "left").withColumn(
            "component", F.coalesce("component", "class_id")
        ),
        "labelled",
    )
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("key")
    )
    rest = settle(
        spark,
        labelled.join(open_keys, "key", "left_semi")
        .where("class_id != leader")
        .select("class_id", "component")
        .distinct(),
        "open",
    )
    further = _joined(rest, sets).toDF("early", "late")
    linked = members.join(labels.toDF("class_id", "component"), "class_id", "left")
    joined = linked.withColumn("early", F.coalesce("component", "class_id")).join(further, "early", "left")
    component = F.coalesce("late", "early", "doc_id")
    found = joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )
    unnamed = sketched.where("doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return found.unionByName(unnamed)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose document is the smallest id of its component, columns unchanged.

    Rows with a null id, and texts without a word, stay. Rows that repeat an id stay or go together. Other columns may have any
    name; an empty table gives no rows.
    """
    dropped = settle(
        docs.sparkSession, near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone")), "dropped"
    )
    # Columns of docs are numbered, so that none clashes with the id that is joined.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("doc_id")
    return numbered.join(by_ids(dropped), F.col(f"c{at}") == F.col("gone"), "left_anti").toDF(*docs.columns)
