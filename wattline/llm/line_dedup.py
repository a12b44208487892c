"""Line deduplication by a segment-partition edit join.

Lines within ``DISTANCE`` edits of each other (in UTF-8 bytes) are copies. A line is split into
``DISTANCE + 1`` segments; one of them survives the edits unchanged, so it occurs in the other line,
near its own place. Every line is a probe and an entry of the index: its segments are entries under
(length, number, content), and for its own and each smaller length it probes the substrings that can be
a segment of a line of that length, at the few places that the numbers of edits on either side allow.
Lines that meet under a key are verified by edit distance, in a band of 2 x ``DISTANCE`` + 1
rows held in one machine word, for thousands of pairs at a time: first every line with the smallest of its
key. Lines of a key that are then still apart are described by the grams in which they differ from what is common to
their group. Two edits change few grams, so linked lines agree in most of these differences, and only lines
that share one of their rarest, and whose bags of short grams are as near as two edits leave them, are compared: many
lines made from one original, but not alike, hardly meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import _parse_datatype_string

from wattline.llm.batches import map_batches
from wattline.llm.graphs import components
from wattline.llm.hashing import PIECE, mix64, prefix_sums
from wattline.llm.joins import by_ids
from wattline.llm.linking import linked_components, pairs_apart
from wattline.session import settle

DISTANCE = 2
#: Bytes of a gram. An edit changes at most so many grams of a line, on either side.
GRAM = 4
#: Grams in which linked lines differ at most.
APART = 2 * GRAM * DISTANCE
#: Longs that hold the parities of a line's grams of 1, 2, ... ``GRAM`` bytes: as many as a gram has bytes.
MARKS = [(size, word) for size in range(1, GRAM + 1) for word in range(size)]
#: Lines of a group that its common grams are taken from.
SAMPLE = 15
#: Elements are counted in so many cells (a power of two), a table of 4 MB; the order need not be exact.
CELL_BITS = 20
#: Shorter lines, in bytes, are copies only if equal: two edits turn many short lines into others.
LEAST = 20


def segments(length: int, parts: int = DISTANCE + 1) -> list[tuple[int, int]]:
    """Start and size of each of ``parts`` segments, as even as possible, longer ones last."""
    size, longer = divmod(length, parts)
    found, at = [], 0
    for i in range(parts):
        take = size + (i >= parts - longer)
        found.append((at, take))
        at += take
    return found


def shifts(delta: int, number: int, distance: int = DISTANCE) -> range:
    """Where segment ``number`` (from 0) of a line shorter by ``delta`` can begin in the probe, relative to its start.

    At most ``number`` edits lie before it when this is the first segment that survives, and at
    most ``distance - number`` behind it when it is the last one.
    """
    low = max(-number, delta - (distance - number))
    high = min(number, delta + (distance - number))
    return range(low, high + 1)


def line_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of each line, one row per line; those that a line has none of repeat its first."""
    sums, inverse = prefix_sums(data)
    parts, columns = DISTANCE + 1, []
    for delta in range(DISTANCE + 1):
        shorter = lengths - delta
        size, longer = shorter // parts, shorter % parts
        for number in range(parts):
            take = size + (number >= parts - longer)
            begin = number * size + np.maximum(0, number - (parts - longer))
            for shift in shifts(delta, number):
                at = begin + shift
                ok = (at >= 0) & (at + take <= lengths) & (shorter >= LEAST)
                at = starts + np.where(ok, at, 0)
                content = (sums[at + np.where(ok, take, 0)] - sums[at]) * inverse[at]
                name = (shorter * parts + number).astype(np.uint64)
                columns.append((mix64(content + mix64(name + np.uint64(1))), ok))
    first = columns[0][0]
    return np.stack([np.where(ok, key, first) for key, ok in columns], axis=1).view(np.int64)


def within_distance(pairs: list[tuple[bytes, bytes]], distance: int = DISTANCE) -> np.ndarray:
    """Which pairs are at most ``distance`` edits apart.

    Column by column, bits of one word hold the vertical differences of the rows around the diagonal;
    the score follows the diagonal that ends in the corner. All pairs advance together, longest first.
    """
    near = np.zeros(len(pairs), bool)
    ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    rest = np.array([i for i, (a, b) in enumerate(ordered) if len(a) - len(b) <= distance], np.int64)
    if not len(rest):
        return near
    rest = rest[np.argsort([-len(ordered[i][1]) for i in rest], kind="stable")]
    band = 2 * distance + 1
    long_, short = [ordered[i][0] for i in rest], [ordered[i][1] for i in rest]
    # Margins of zeros stand for rows outside the line; the tests of rows below keep real zeros apart from them.
    rows = np.frombuffer(b"".join(bytes(distance) + t + bytes(band) for t in long_), np.uint8)
    row_at = np.cumsum([0] + [len(t) + distance + band for t in long_])[:-1]
    columns = np.frombuffer(b"".join(short), np.uint8)
    m = np.array([len(t) for t in long_])
    n = np.array([len(t) for t in short])
    column_at = np.cumsum(n) - n
    offset = m - n
    score = offset.copy()
    positive = np.full(len(rest), ((1 << band) - 1) ^ ((1 << distance) - 1), np.int64)
    negative = np.zeros(len(rest), np.int64)
    full = (1 << band) - 1
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), side="left")
    for j in range(steps):
        k = active[j]
        symbol = columns[column_at[:k] + j]
        match = np.zeros(k, np.int64)
        for bit in range(band):
            row = j - distance + bit  # from 0
            if row >= 0:
                same = (rows[row_at[:k] + row + distance] == symbol) & (row < m[:k])
                match |= same.astype(np.int64) << bit
        up, down = positive[:k], negative[:k]
        free = ((((match & up) + up) ^ up) | match | down) & full
        plus = (down | ~(free | up)) & full
        minus = free & up
        score[:k] += 1 - (free >> (offset[:k] + distance) & 1)
        positive[:k] = (minus | ~((free >> 1) | plus)) & full
        negative[:k] = (free >> 1) & plus
    near[rest] = score <= distance
    return near


def _split(batch: pa.RecordBatch):
    """The lines of a slice: row, number and bytes of each, and the hash of each row's text."""
    rows, numbers, lines = [], [], []
    for row, text in enumerate(batch.column(1).to_pylist()):
        found = (text or "").encode().split(b"\n")
        rows += [row] * len(found)
        numbers += range(len(found))
        lines += found
    return np.array(rows), numbers, lines


def _digests(lines: list[bytes]) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(line, digest_size=16).digest() for line in lines)
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def _lines(docs: DataFrame, kind: str) -> DataFrame:
    """One row per line: its place, digest, size, and whether it is blank."""

    def work(batch: pa.RecordBatch):
        rows, numbers, lines = _split(batch)
        digests = _digests(lines)
        return [
            *(batch.column(i).take(pa.array(rows)) for i in (0, 2)),
            numbers,
            pa.array(digests[:, 0]),
            pa.array(digests[:, 1]),
            [len(line) for line in lines],
            [not line.strip() for line in lines],
        ]

    return map_batches(
        docs, work, f"doc_id {kind}, text_hash long, line_no int, hi long, lo long, n int, blank boolean"
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """hi, lo, n, keys of every line of at least ``LEAST`` bytes, once per slice."""

    def work(batch: pa.RecordBatch):
        lines = sorted({line for line in _split(batch)[2] if len(line) >= LEAST})
        if not lines:
            return None
        digests = _digests(lines)
        lengths = np.array([len(line) for line in lines])
        keys, at = [], 0
        while at < len(lines):  # parts within the reach of the hash tables; a longer line comes alone
            stop, size = at, 0
            while stop < len(lines) and (stop == at or size + lengths[stop] + 1 < PIECE):
                size += lengths[stop] + 1
                stop += 1
            part = lengths[at:stop]
            data = np.frombuffer(b"\n".join(lines[at:stop]) + b"\n", np.uint8)
            keys.append(line_keys(data, np.cumsum(part + 1) - part - 1, part))
            at = stop
        flat = np.concatenate(keys)
        offsets = pa.array(np.arange(len(lines) + 1) * flat.shape[1], pa.int32())
        return [
            pa.array(digests[:, 0]),
            pa.array(digests[:, 1]),
            pa.array(lengths),
            pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1))),
        ]

    return map_batches(docs, work, "hi long, lo long, n int, keys array<long>")


def _texts_of(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """node, content of the lines ``wanted`` (node), a stored table: their documents are read again."""
    ids = wanted.select(F.col("node.doc_id").alias("doc_id"))

    def work(batch: pa.RecordBatch):
        rows, numbers, lines = _split(batch)
        return [*(batch.column(i).take(pa.array(rows)) for i in (0, 2)), numbers, pa.array(lines, pa.binary())]

    read = docs.join(by_ids(ids.toDF("__id")), docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    lines = map_batches(read, work, f"doc_id {kind}, text_hash long, line_no int, content binary")
    node = F.struct("doc_id", "text_hash", "line_no").alias("node")
    return lines.select(node, "content").join(by_ids(wanted), "node", "left_semi").dropDuplicates(["node"])


def _gram_hashes(line: bytes) -> np.ndarray:
    """Hashes of the grams of a line; repeated grams are numbered, so the hashes differ."""
    data = np.frombuffer(line, np.uint8).astype(np.uint64)
    hashes = np.zeros(len(line) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        hashes = hashes * np.uint64(257) + data[k : k + len(hashes)]
    hashes.sort()
    fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(hashes)), 0))
    return mix64(hashes + mix64((np.arange(len(hashes)) - first).astype(np.uint64)))


def _grams(line: bytes) -> np.ndarray:
    """The set of a line's grams in 32 bits, sorted. Grams that meet there make sets more alike, never less."""
    return np.unique((_gram_hashes(line) >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _marks(line: bytes) -> np.ndarray:
    """For each size of grams, in as many longs: in which cells the line's grams, repeated ones too, are odd in number.

    An edit takes away and adds at most so many grams as a gram has bytes, and each turns one cell.
    """
    data = np.frombuffer(line, np.uint8).astype(np.uint64)
    found = []
    for size in range(1, GRAM + 1):
        grams = np.zeros(max(0, len(line) - size + 1), np.uint64)
        for k in range(size):
            grams = grams * np.uint64(257) + data[k : k + len(grams)]
        # Single bytes are their own cells, which keeps ASCII letters of one case apart.
        cells = (grams if size == 1 else mix64(grams)) % np.uint64(64 * size)
        odd = np.bincount(cells.astype(np.int64), minlength=64 * size) & 1
        found.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"))
    return np.concatenate(found)


def marks_alike() -> str:
    """Condition on ``marks`` and ``other_marks`` that linked lines meet."""
    found = []
    for size in range(1, GRAM + 1):
        at = [i for i, (of, _) in enumerate(MARKS) if of == size]
        odd = " + ".join(f"bit_count(marks[{i}] ^ other_marks[{i}])" for i in at)
        found.append(f"{odd} <= {2 * size * DISTANCE}")
    return " and ".join(found)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _sampled(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """leader, common: the grams that most of at most ``SAMPLE`` lines of each group have.

    Any set would do: it only makes signatures short. Lines made from one original by different edits
    agree on the original's grams.
    """
    kind = dict(rest.dtypes)["leader"]
    order = Window.partitionBy("leader").orderBy(F.xxhash64("node"), "node")
    few = rest.select("leader", "node").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE)
    lines = few.join(texts, "node").groupBy("leader").agg(F.collect_list("content").alias("lines"))

    def work(batch: pa.RecordBatch):
        common = []
        for lines in batch.column(0).to_pylist():
            grams, counts = np.unique(np.concatenate([_grams(line) for line in lines]), return_counts=True)
            common.append(grams[2 * counts > len(lines)])
        return [batch.column(1), pa.array(common, pa.list_(pa.int32()))]

    # The first column is the text that slices are cut by; here it is a list of lines.
    schema = f"leader {kind}, common array<int>"
    return settle(rest.sparkSession, _mapped(lines.select("lines", "leader"), work, schema), "common-grams")


def _mapped(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on slices of a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                columns = work(batch.slice(at, 256))
                yield pa.RecordBatch.from_arrays(list(columns), names=names)

    names = [part.name for part in _parse_datatype_string(schema)]
    return rows.mapInArrow(run, schema)


def _signatures(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """``rest`` (leader, node, component, n) with ``marks`` and ``elements``: the grams in which a line and its group's common grams differ.

    Elements carry their group. An edit changes at most ``GRAM`` grams on either side, so the signatures of linked lines
    differ in at most ``APART`` elements.
    """
    nodes = dict(rest.dtypes)
    rows = rest.join(texts, "node").join(_sampled(rest, texts), "leader")
    wanted = rows.select("content", "leader", "node", "component", "n", "common", F.xxhash64("leader").alias("group"))

    def work(batch: pa.RecordBatch):
        elements = []
        for line, common, group in zip(*(batch.column(i).to_pylist() for i in (0, 5, 6))):
            grams, common = _grams(line), np.array(common, np.int32)
            novel, missing = np.setdiff1d(grams, common, True), np.setdiff1d(common, grams, True)
            names = np.concatenate((novel.astype(np.uint32).astype(np.uint64), missing.astype(np.uint32).astype(np.uint64) + np.uint64(1 << 32)))
            elements.append(mix64(names + mix64(np.array([group], np.int64).view(np.uint64))).view(np.int64))
        sizes = pa.array([len(e) for e in elements], pa.int32())
        marks = pa.array([_marks(line) for line in batch.column(0).to_pylist()], pa.list_(pa.int64()))
        return [*batch.columns[1:5], batch.column(6), sizes, marks, pa.array(elements, pa.list_(pa.int64()))]

    schema = (
        f"leader {nodes['leader']}, node {nodes['node']}, component {nodes['component']}, n int, group long, size int, "
        "marks array<long>, elements array<long>"
    )
    return settle(rest.sparkSession, _mapped(wanted, work, schema), "signatures")


def _element_counts(signatures: DataFrame) -> np.ndarray:
    """How many elements fall into each of a fixed number of cells."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=len(total))
        if total.any():
            packed = [zstandard.compress(part.tobytes(), 1) for part in total.reshape(16, -1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(16), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"]
            )

    def summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                total = total + np.frombuffer(zstandard.decompress(packed), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())],
            names=["block", "counts"],
        )

    schema = "block int, counts binary"
    blocks = signatures.select("elements").mapInArrow(partial, schema).groupBy("block").applyInArrow(summed, schema).collect()
    counts = np.zeros((16, (1 << CELL_BITS) // 16), np.int64)
    for row in blocks:
        counts[row.block] = np.frombuffer(zstandard.decompress(bytes(row.counts)), np.int64)
    return np.minimum(counts.ravel(), 2**31 - 1).astype(np.int32)


def _rarest(signatures: DataFrame) -> DataFrame:
    """element, node, component, n, size, marks, whole: so many of each signature's elements that linked lines share one.

    Of ``APART`` + 1 elements of a line a linked line has at least one, and so it is with the first ones in any common order:
    here by the count of the element's cell, then by hash. Lines whose signatures are so small that linked ones may have nothing in common
    share one element more, which stands for the group as a whole (``whole``).
    """
    kinds = dict(signatures.dtypes)
    shared = signatures.sparkSession.sparkContext.broadcast(_element_counts(signatures))

    def work(batch: pa.RecordBatch):
        rows, found, whole = [], [], []
        for row, (elements, group) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist())):
            hashes = np.array(elements, np.int64).view(np.uint64)
            chosen = hashes[np.lexsort((hashes, shared.value[_cells(hashes)]))[: APART + 1]]
            whole.append(np.zeros(len(chosen), bool))
            if len(hashes) <= APART:
                chosen = np.append(chosen, np.array([group], np.int64).view(np.uint64))
                whole.append(np.ones(1, bool))
            found.append(chosen)
            rows.append(np.full(len(chosen), row))
        at = pa.array(np.concatenate(rows))
        columns = (batch.column(i).take(at) for i in (1, 2, 3, 4, 6))
        return [pa.array(np.concatenate(found).view(np.int64)), *columns, pa.array(np.concatenate(whole))]

    schema = f"element long, node {kinds['node']}, component {kinds['component']}, n int, size int, marks array<long>, whole boolean"
    rows = signatures.select("elements", "node", "component", "n", "size", "group", "marks")
    return _mapped(rows, work, schema).dropDuplicates(["element", "node"])


def _small_pairs(rows: DataFrame, near: str) -> DataFrame:
    """Pairs (a, b) of lines of a group, of different components, whose signatures are so small that they may have nothing in common.

    The smaller signature has a size that fits the larger one, so a line meets only lines of such sizes.
    """
    rows = rows.withColumnRenamed("element", "group")
    larger = rows.toDF(*["group" if c == "group" else f"other_{c}" for c in rows.columns]).withColumn(
        "size", F.explode(F.sequence(F.lit(0), F.least("other_size", F.lit(APART) - F.col("other_size"))))
    )
    pairs = rows.where(2 * F.col("size") <= APART).join(larger, ["group", "size"])
    return (
        pairs.where("component != other_component and (size < other_size or node < other_node)")
        .where(near)
        .select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))
        .distinct()
    )


def _links_apart(rest: DataFrame, texts: DataFrame, verify) -> DataFrame:
    """Links between different components among lines that share a key's group.

    Lines of an element are first compared with the one that is nearest to its group's common grams, then those that are still apart with
    each other. Around one original these are few: what is common to the group is in no signature.
    """
    spark = rest.sparkSession
    near = f"abs(n - other_n) <= {DISTANCE} and abs(size - other_size) <= {APART} and {marks_alike()}"
    prefixes = settle(spark, _rarest(_signatures(rest, texts)), "prefixes")
    first = (
        prefixes.groupBy("element")
        .agg(
            F.min(F.struct("size", "node", "n", "component", "marks")).alias("first"),
            F.min("component").alias("low"),
            F.max("component").alias("high"),
        )
        .where("low != high")
        .select(
            "element",
            F.col("first.node").alias("other"),
            F.col("first.size").alias("other_size"),
            F.col("first.n").alias("other_n"),
            F.col("first.component").alias("other_component"),
            F.col("first.marks").alias("other_marks"),
        )
    )
    pairs = prefixes.join(first, "element").where("component != other_component").where(near)
    stars = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = verify(stars)
    labels = rest.select("node", "component").distinct()
    ends = links.join(labels.toDF("a", "from"), "a").join(labels.toDF("b", "to"), "b")
    merged = components(ends.select(F.col("from").alias("a"), F.col("to").alias("b")).where("a != b"))
    relabelled = prefixes.join(merged.toDF("component", "joined"), "component", "left").select(
        "element", "node", F.coalesce("joined", "component").alias("component"), "n", "size", "marks", "whole"
    )
    relabelled = settle(spark, relabelled, "relabelled")
    # Signatures that differ in at most APART elements have so many in common, of which the prefixes hold all but those behind the shorter end.
    common = f"(size + other_size - {APART}) / 2 - greatest(0, greatest(size, other_size) - {APART + 1})"
    apart = pairs_apart(relabelled.where("not whole"), near, common).union(_small_pairs(relabelled.where("whole"), near))
    return links.union(verify(apart.distinct()))


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, text_hash, line_no, n (bytes), first, class, kept, reason.

    Lines are what line breaks separate; null is the empty text, of one empty line. ``first`` is the
    first place, by id (null first), hash of the text and number, of an equal line, ``class`` the first place
    of all lines that chains of links reach. The line at that place is kept, and so are blank
    lines (reason ``blank``); others are ``equal`` or ``near`` copies. Rows that repeat id and text have
    the same places, and keep the same lines. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    lines = settle(spark, _lines(rows, kind), "lines")
    place = F.struct("doc_id", "text_hash", "line_no")
    firsts = lines.where("not blank").groupBy("hi", "lo").agg(F.min(place).alias("first"))
    firsts = settle(spark, firsts, "first-lines")
    keyed = _keyed(rows)
    live = (
        keyed.select("hi", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.min("hi").alias("low"), F.max("hi").alias("high"))
        .where("low != high")
        .select("key")
    )
    live = settle(spark, live, "live-keys")
    shared = (
        keyed.select("hi", "lo", "n", F.explode("keys").alias("key"))
        .join(by_ids(live), "key", "left_semi")
        .distinct()
        .join(firsts, ["hi", "lo"])
        .select("key", F.col("first").alias("node"), "n")
    )

    shared = settle(spark, shared, "line-keys")
    nodes = settle(spark, shared.select("node").distinct(), "line-nodes")
    texts = settle(spark, _texts_of(rows, nodes, kind), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        both = (
            settle(spark, pairs, "line-pairs")
            .join(texts.toDF("a", "text_a"), "a")
            .join(texts.toDF("b", "text_b"), "b")
            .select("text_a", "text_b", "a", "b")
        )

        def work(batch: pa.RecordBatch):
            near = within_distance(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            keep = pa.array(near)
            return [batch.column(i).filter(keep) for i in (2, 3)]

        of = f"struct<doc_id:{kind},text_hash:bigint,line_no:int>"
        return settle(spark, map_batches(both, work, f"a {of}, b {of}", 0), "line-links")

    alike = f"abs(n - other_n) <= {DISTANCE}"

    found = linked_components(shared, alike, verify, lambda rest: _links_apart(rest, texts, verify))
    classes = firsts.join(found.toDF("first", "class"), "first", "left").select(
        "hi", "lo", "first", F.coalesce("class", "first").alias("class")
    )
    here = F.col("class") == place
    reason = F.when(F.col("blank"), "blank").when(here, "first").when(F.col("first") == place, "near").otherwise("equal")
    return lines.join(classes, ["hi", "lo"], "left").select(
        "doc_id",
        "text_hash",
        "line_no",
        "n",
        "first",
        "class",
        (F.col("blank") | here).alias("kept"),
        reason.alias("reason"),
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (id and text): doc_id, n_lines, n_kept, n_equal, n_near, kept_bytes (without line breaks)."""
    copies = F.count_if(F.col("line_no") == 0)  # of a row that is repeated

    def per_row(total):
        return (total / copies).cast("long")

    return (
        line_decisions(docs, id_col, text_col)
        .groupBy("doc_id", "text_hash")
        .agg(
            per_row(F.count(F.lit(1))).alias("n_lines"),
            per_row(F.count_if("kept")).alias("n_kept"),
            per_row(F.count_if(F.col("reason") == "equal")).alias("n_equal"),
            per_row(F.count_if(F.col("reason") == "near")).alias("n_near"),
            per_row(F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0))).alias("kept_bytes"),
        )
        .drop("text_hash")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text of every document (id and text) with the kept lines alone, in their order."""
    gone = (
        line_decisions(docs, id_col, text_col)
        .where("not kept")
        .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
        .agg(F.collect_set("line_no").alias("__gone"))
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    joined = rows.join(
        gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left"
    )
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<int>")), i))
    return joined.select("doc_id", F.array_join(kept, "\n").alias("text"))
