"""Hard-negative mining over an inverted multi-index, with certified windows.

Two codebooks, one for each half of the dimensions, are fitted to a bounded sample; the pair of nearest codewords
is the cell of a vector, and all vectors are indexed. For an anchor ``q`` no vector of cell (i, j) scores more
than ``q1 . c1_i + |q1| r1_i + q2 . c2_j + |q2| r2_j`` with the radii ``r`` of the two half cells, which are the
largest distances over all vectors. A heap over the two lists of half scores, each in falling order, visits
cells by falling bound (the multi-sequence algorithm). An anchor is done as soon as the next cell's bound is below what it still
needs: first its last positive, then, for each positive, the last negative of that positive's window of scores, or
the window's lower end. So the result is exact, and the sizes of codebooks and batches change the work only.

Cells are visited twice: the first FIRST_CELLS of an anchor tell what it needs, then all cells whose bound reaches that.
Cells lie in shelves of a bounded number of vectors, a big cell in several; a visit is a co-grouping of shelves with the
anchors that ask for one of their cells, in blocks of anchors, so that no task holds more than a shelf and a block.
There, a cell's vectors are multiplied with the anchors that want the cell, and only scores that an anchor still
needs are ordered. The anchors are the stated query set.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from wattline.llm.vectors import EXACT, EXACT_SINGLE, grid_rows, matrix, packed, unpacked
from wattline.plans.sizes import small_side
from wattline.session import settle

#: Rows whose vectors the codebooks are fitted to, codewords of a half at most, and rounds of the fit.
SAMPLE_ROWS, MOST_WORDS, FIT_ROUNDS = 20_000, 128, 8
#: Vectors of a cell on average, vectors of a shelf, anchors of a block, and cells of the first visit.
CELL_ROWS, SHELF_ROWS, BLOCK_ANCHORS, FIRST_CELLS = 256, 16384, 4096, 32
#: Anchors and vectors whose scores a task holds at once, and scores that wait to be ordered.
_STRIP, _WIDTH, _WAITING = 512, 2048, 1 << 19
#: Lower end of a window that nothing can meet, and ends of one that everything meets.
_NEVER, _LEAST, _MOST = 1 << 62, -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks with radii, and where the vectors of each cell lie."""

    words: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: np.ndarray  # numbers of the cells that hold vectors, ascending
    first_shelf: np.ndarray
    shelves: np.ndarray  # number of shelves of each of these cells
    most: int  # largest size of an entry

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest half scores of each codeword's vectors with each row of ``q``, rounded up."""
        half = self.words[0].shape[1]
        found = []
        for part, words, radii in zip((q[:, :half], q[:, half:]), self.words, self.radii):
            part = part.astype(np.float64)
            reach = np.sqrt((part * part).sum(axis=1))[:, None] * np.maximum(radii, 0)
            slack = 1e-9 * (np.abs(part) @ np.abs(words).T + reach + 1)
            found.append(np.where(radii < 0, -np.inf, part @ words.T + reach + slack))
        return found[0], found[1]

    @property
    def entry(self) -> np.dtype:
        """The smallest kind of whole number that holds every entry."""
        return np.dtype("<i2" if self.most < 1 << 15 else "<i4" if self.most < 1 << 31 else "<i8")

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """``x`` in a kind of number whose products are exact."""
        most = max(self.most, 1) ** 2 * x.shape[1]
        return x.astype(np.float32 if most < EXACT_SINGLE else np.float64 if most < EXACT else object)


def visit(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Pairs of places by falling sum of both lists: the multi-sequence algorithm. Infinitely low places are left out."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = a[first[a] > -np.inf], b[second[b] > -np.inf]
    if not len(a) or not len(b):
        return
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    reached = np.zeros(len(a) + 1, np.int64)  # pairs (i, 0 .. reached[i] - 1) have been visited
    while heap:
        low, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j]), -low
        reached[i] = j + 1
        # (i, j) comes after (i - 1, j) and (i, j - 1), so each pair enters the heap once.
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[j]]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))


def codebook(sample: np.ndarray, words: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Codewords by Lloyd's rounds, from starts that lie far apart. Fewer words where fewer vectors differ."""
    sample = sample.astype(np.float64)
    chosen = [sample[0]]
    nearest = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < words and nearest.max() > 0:
        # The vector at the middle of the summed squared distances: spread out, and the same in every run.
        total = np.cumsum(nearest)
        chosen.append(sample[int(np.searchsorted(total, total[-1] * ((len(chosen) * 0.618034) % 1), side="right").clip(0, len(sample) - 1))])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(axis=1))
    book = np.unique(np.array(chosen), axis=0)
    for _ in range(rounds):
        near = nearest_words(sample, book)[0]
        for k in range(len(book)):
            if (near == k).any():
                book[k] = sample[near == k].mean(axis=0)
    return book


def nearest_words(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest codeword of each vector and the distance to it."""
    x = x.astype(np.float64)
    near = ((book * book).sum(axis=1)[None, :] - 2 * x @ book.T).argmin(axis=1)
    return near, np.sqrt(((x - book[near]) ** 2).sum(axis=1))


def build(vectors: DataFrame) -> tuple[MultiIndex | None, DataFrame]:
    """The index of ``vectors`` (vec_id, label, x) and the rows with their ``shelf`` and ``cell``.

    Codebooks are fitted to at most about SAMPLE_ROWS rows, chosen by a hash of the id; radii and places come from all rows.
    """
    spark = vectors.sparkSession
    n, low, high = vectors.agg(F.count(F.lit(1)), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n:
        return None, vectors
    share = F.pmod(F.xxhash64("vec_id", "x"), F.lit(1 << 32)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 32))
    sample = vectors.where(share).select("vec_id", "x").orderBy("vec_id", "x").limit(2 * SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        sample = vectors.select("vec_id", "x").orderBy("vec_id", "x").limit(1).toArrow()
    x = matrix(sample.column("x").combine_chunks())
    half = x.shape[1] // 2
    words = int(np.clip(np.sqrt(n / CELL_ROWS), 1, MOST_WORDS))
    books = (codebook(x[:, :half], words), codebook(x[:, half:], words))
    wide = len(books[1])
    entry = MultiIndex(books, (), (), (), (), max(-low, high)).entry

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(batch.schema.get_field_index("x")))
                (i, near_i), (j, near_j) = nearest_words(x[:, :half], books[0]), nearest_words(x[:, half:], books[1])
                added = [packed(x, entry), pa.array(i * wide + j), pa.array(near_i), pa.array(near_j)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added], names=["vec_id", "label", "x", "cell", "r1", "r2"])

    kinds = dict(vectors.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary, cell long, r1 double, r2 double"
    indexed = settle(spark, vectors.select("vec_id", "label", "x").mapInArrow(placed, schema), "multi-index")
    # At most MOST_WORDS^2 cells, whatever the number of rows.
    found = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("cell").collect()
    cells = np.array([r["cell"] for r in found], np.int64)
    radii = tuple(np.full(len(book), -np.inf) for book in books)
    first, shelves, shelf, held = [], [], 0, 0
    for r in found:
        i, j = divmod(r["cell"], wide)
        radii[0][i], radii[1][j] = max(radii[0][i], r["r1"]), max(radii[1][j], r["r2"])
        if held and held + r["n"] > SHELF_ROWS:
            shelf, held = shelf + 1, 0
        first.append(shelf)
        shelves.append(max(1, -(-r["n"] // SHELF_ROWS)))
        if shelves[-1] > 1:
            shelf, held = shelf + shelves[-1], 0
        else:
            held += r["n"]
    index = MultiIndex(books, radii, cells, np.array(first), np.array(shelves), max(-low, high))

    def shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(index.cells, batch.column(3).to_numpy())
            shelf = index.first_shelf[at] + batch.column(4).to_numpy() % index.shelves[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shelf, pa.int64())], names=["vec_id", "label", "x", "cell", "shelf"])

    spread = indexed.select("vec_id", "label", "x", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).alias("part"))
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x binary, cell long, shelf long"
    return index, spread.mapInArrow(shelved, schema)


def _requests(anchors: DataFrame, index: MultiIndex, first_cells: int | None, id_type: str, label_type: str) -> DataFrame:
    """(shelf, block, anchor, label, x, needs, highs, least): the shelves that each anchor wants to see.

    It wants the cells whose bound reaches ``least``: the lowest score that it still needs, or with ``first_cells`` the bound
    of so many cells by falling bound, if that is higher.
    """
    wide = len(index.words[1])
    shelf_starts = np.flatnonzero(np.diff(index.first_shelf, prepend=-1))
    held = {int(c) for c in index.cells}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x = matrix(part.column(2))
                least = np.array([min(needs, default=_MOST) for needs in part.column(3).to_pylist()], np.float64)
                one, two = index.bounds(x)
                if first_cells is not None:
                    for at in range(len(x)):
                        place = 0
                        for i, j, bound in visit(one[at], two[at]):
                            place += i * wide + j in held
                            if place >= first_cells or bound < least[at]:
                                least[at] = max(least[at], bound)
                                break
                wanted = one[:, index.cells // wide] + two[:, index.cells % wide] >= least[:, None]
                wanted = np.logical_or.reduceat(wanted, shelf_starts, axis=1)
                row, at = np.nonzero(wanted)
                # A cell of several shelves has these for itself.
                many = index.shelves[shelf_starts[at]]
                row, first = np.repeat(row, many), np.repeat(index.first_shelf[shelf_starts[at]], many)
                shelf = first + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                columns = [part.column(0), part.column(1), packed(x, index.entry), *part.columns[3:6], pa.array(least)]
                taken = [c.take(pa.array(row)) for c in columns]
                names = ["shelf", "anchor", "label", "x", "needs", "highs", "block", "least"]
                yield pa.RecordBatch.from_arrays([pa.array(shelf, pa.int64()), *taken], names=names)

    schema = (
        f"shelf long, anchor {id_type}, label {label_type}, x binary, needs array<long>, highs array<long>, block long, least double"
    )
    return anchors.select("anchor", "label", "x", "needs", "highs", "block").mapInArrow(run, schema)


def _first_of(group: np.ndarray, scores: np.ndarray, codes: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the places of its first ``top`` by falling score, then code; and whether a place is the last of so many."""
    falling = -scores if scores.dtype != object else np.unique(-scores, return_inverse=True)[1]
    order = np.lexsort((codes, falling, group))
    group = group[order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    place = np.arange(len(group)) - np.repeat(starts, np.diff(starts, append=len(group)))
    return order[place < top], place[place < top] == top - 1


def _score_shelf(rows: pa.Table, asked: pa.Table, index: MultiIndex, *, top: int, same_label: bool) -> dict[str, list]:
    """The best of a shelf for every anchor and slot: anchor, slot, score, vec_id.

    A slot is a window of scores ``needs`` to ``highs``, over other rows of the anchor's label with ``same_label``, over rows of other labels
    without. Equal scores are ordered by id.
    """
    rows = rows.take(pc.sort_indices(rows, [("cell", "ascending"), ("vec_id", "ascending")]))
    ids, anchors = rows.column("vec_id").combine_chunks(), asked.column("anchor").combine_chunks()
    codes = np.empty(len(ids), np.int64)
    codes[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    own = pc.fill_null(pc.index_in(anchors, value_set=ids), -1).to_numpy(zero_copy_only=False)
    label_codes = {v: k for k, v in enumerate(dict.fromkeys(rows.column("label").to_pylist()))}
    labels = np.array([label_codes[v] for v in rows.column("label").to_pylist()], np.int32)
    mine = np.array([label_codes.get(v, -1) for v in asked.column("label").to_pylist()], np.int32)
    whole = unpacked(asked.column("x"), index.entry)
    x, q = index.numbers(unpacked(rows.column("x"), index.entry)), index.numbers(whole)
    one, two = index.bounds(whole)
    one, two, least = one.T.copy(), two.T.copy(), asked.column("least").to_numpy()
    slots = max((len(v) for v in asked.column("needs").to_pylist()), default=0)
    needs = np.array([[*v, *[_MOST] * (slots - len(v))] for v in asked.column("needs").to_pylist()], np.int64)
    highs = np.array([[*v, *[_LEAST] * (slots - len(v))] for v in asked.column("highs").to_pylist()], np.int64)
    lowest = needs.min(axis=1, initial=_MOST)
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype))
    best, waiting = [empty] * slots, [empty]

    def order() -> None:
        """Puts what waits into the best of each slot, and raises what the anchors need."""
        anchor, column, score = (np.concatenate(part) for part in zip(*waiting))
        waiting[:] = [empty]
        for slot in range(slots):
            fits = (score >= needs[anchor, slot]) & (score <= highs[anchor, slot])
            a, c, s = (np.concatenate((old, new[fits])) for old, new in zip(best[slot], (anchor, column, score)))
            kept, last = _first_of(a, s, codes[c], top)
            best[slot] = a[kept], c[kept], s[kept]
            needs[a[kept][last], slot] = s[kept][last]
        lowest[:] = needs.min(axis=1, initial=_MOST)

    cells = rows.column("cell").to_numpy()
    wide = len(index.words[1])
    starts = np.flatnonzero(np.diff(cells, prepend=-1))
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]):
        i, j = divmod(int(cells[start]), wide)
        wanting = np.flatnonzero(one[i] + two[j] >= np.maximum(least, lowest))
        for at in range(0, len(wanting), _STRIP):
            strip = wanting[at : at + _STRIP]
            for first in range(start, stop, _WIDTH):
                columns = slice(first, min(first + _WIDTH, stop))
                scores = q[strip] @ x[columns].T
                ok = scores >= lowest[strip].astype(q.dtype)[:, None]
                if same_label:
                    ok &= labels[columns] == mine[strip][:, None]
                found = np.flatnonzero(ok)
                row, column = np.divmod(found, scores.shape[1])
                anchor, column, score = strip[row], column + first, scores.ravel()[found]
                other = column != own[anchor]
                if not same_label:
                    other &= labels[column] != mine[anchor]
                waiting.append((anchor[other], column[other], score[other]))
                if sum(len(w[0]) for w in waiting) > _WAITING:
                    order()
    order()
    out: dict[str, list] = {"anchor": [], "slot": [], "score": [], "vec_id": []}
    for slot, (anchor, column, score) in enumerate(best):
        out["anchor"] += anchors.take(pa.array(anchor)).to_pylist()
        out["slot"] += [slot] * len(anchor)
        out["score"] += [int(v) for v in score]
        out["vec_id"] += ids.take(pa.array(column)).to_pylist()
    return out


def _search(anchors: DataFrame, index: MultiIndex, shelves: DataFrame, *, top: int, same_label: bool) -> DataFrame:
    """anchor, slot, rank, score, vec_id: the exact best ``top`` rows of every anchor and slot.

    ``anchors`` has anchor, label, x, block, needs and highs: the lower and upper ends of the slots.
    """
    spark = anchors.sparkSession
    kinds = dict(anchors.dtypes)
    id_type, label_type = kinds["anchor"], kinds["label"]
    schema = f"anchor {id_type}, slot int, score long, vec_id {id_type}"

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        fields = pa.schema([("anchor", asked.schema.field("anchor").type), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", asked.schema.field("anchor").type)])
        if not rows.num_rows or not asked.num_rows:
            return fields.empty_table()
        found = _score_shelf(rows, asked, index, top=top, same_label=same_label)
        return pa.table([pa.array(found[f.name], f.type) for f in fields], schema=fields)

    def seen(anchors: DataFrame, first_cells: int | None) -> DataFrame:
        asked = settle(spark, _requests(anchors, index, first_cells, id_type, label_type), "requests")
        # Each row goes to the blocks that ask for its shelf.
        spread = shelves.join(small_side(asked.select("shelf", "block").distinct()), "shelf")
        found = spread.groupBy("shelf", "block").cogroup(asked.groupBy("shelf", "block")).applyInArrow(score, schema)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
        return settle(spark, found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "best")

    if len(index.cells) > FIRST_CELLS:
        # A slot that is full needs what beats or ties its last score; another needs all its window holds.
        lasts = seen(anchors, FIRST_CELLS).where(F.col("rank") == top).groupBy("anchor").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_lasts")
        )
        raised = F.transform("needs", lambda need, slot: F.coalesce(F.try_element_at("_lasts", slot), need))
        anchors = anchors.join(lasts, "anchor", "left").withColumn("needs", F.when(F.col("_lasts").isNull(), F.col("needs")).otherwise(raised)).drop("_lasts")
    return seen(anchors, None)


def mine(
    rows: DataFrame,
    anchors: str = "vec_id % 50 = 0",
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of whole numbers ``floor(256 * entry)``. ``anchors`` is a predicate on vec_id, label and x that states the query
    set. Positives of an anchor are its first ``positives`` other rows of the same label by falling score, then ascending id;
    for each, the first ``negatives`` rows of other labels with ``low_percent`` to ``high_percent`` of the
    positive's score come out in the same order, ``rank`` from 1.

    Rows with a null id, a null label, a null or empty vector, null or non-finite entries or another length than most take no part. Of
    rows that repeat an id the one with the smallest (label, vector) counts. Anchors without positives and positives
    whose window holds nothing give no rows; an empty table gives none. Other columns are ignored.
    """
    spark = rows.sparkSession
    given = grid_rows(rows, id_col, vector_col, label_col).where("vec_id is not null and label is not null")
    one = given.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")
    vectors = settle(spark, one, "vectors")
    id_type = dict(vectors.dtypes)["vec_id"]
    schema = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score long, negative_score long"
    index, shelved = build(vectors)
    asking = vectors.where(anchors)
    n_anchors = asking.count()
    if index is None or not n_anchors:
        return spark.createDataFrame([], schema)
    shelves = settle(spark, shelved, "shelves")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(-(-n_anchors // BLOCK_ANCHORS)).cast("long"))
    base = asking.select(F.col("vec_id").alias("anchor"), "label", "x", block.alias("block"))
    first = base.withColumns({"needs": F.array(F.lit(_LEAST).cast("long")), "highs": F.array(F.lit(_MOST).cast("long"))})
    found = _search(first, index, shelves, top=positives, same_label=True)
    # 100 * low_percent * positive <= 100 * 100 * negative, in whole numbers: rounded up below and down above.
    low, high = -_floor_percent(-F.col("score"), low_percent), _floor_percent(F.col("score"), high_percent)
    windows = (
        found.withColumns({"low": F.when(low > high, _NEVER).otherwise(low), "high": high})
        .groupBy("anchor")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
        .select("anchor", F.col("w.low").alias("needs"), F.col("w.high").alias("highs"))
    )
    second = base.join(windows, "anchor")
    chosen = _search(settle(spark, second, "windows"), index, shelves, top=negatives, same_label=False)
    return (
        chosen.withColumnRenamed("rank", "place")
        .withColumn("rank", F.col("slot") + 1)
        .withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(found.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "rank"])
        .select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
        )
    )


def _floor_percent(score, percent: int):
    """Whole part, rounded down, of ``percent`` hundredths of a whole number."""
    part = score * F.lit(percent).cast("long")
    return F.call_function("div", part - F.pmod(part, F.lit(100).cast("long")), F.lit(100).cast("long"))
