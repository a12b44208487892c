"""Language identification by cross-parsing against labelled text.

For every language a suffix automaton of a bounded labelled sample is built. A text is
parsed greedily into the longest phrases that occur in the sample; the language that needs
the fewest phrases, weighted by the logarithm of its sample's size, explains the text best
(cross-parsing entropy in bits per character). Automata of all languages lie in one transition
table, and a worker advances thousands of text blocks by one character at a time in numpy.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wattline.llm.batches import map_batches

#: Characters of a block. Blocks of a text are parsed in parallel, and then from one into the next until both parses agree.
BLOCK = 1024
#: Rows of the sample over all languages, and bytes of the dense transition table; both bound what is broadcast.
SAMPLE_ROWS, TABLE_BYTES = 2400, 64 << 20
UNDETERMINED = "und"
_CODES = 0x110000


@dataclass
class Model:
    """Languages in order, sample sizes, character classes and the joint transition table.

    ``table[state + class]`` is twice the next state, plus one where a new phrase begins;
    states are multiples of the table's width. Class 0 is a run of other characters
    than letters; letters that no sample has share the last but one class of the table, and the last is padding. Classes from the
    width on are rarer letters: their transitions are ``rare_moves`` at the place of state + class x ``rare_step`` in ``rare_keys``.
    """

    languages: list[str]
    sizes: np.ndarray
    classes: np.ndarray
    letters: np.ndarray
    roots: np.ndarray
    table: np.ndarray
    pad: int
    rare_keys: np.ndarray
    rare_moves: np.ndarray
    rare_step: int

    def moves(self, root: int, state: np.ndarray, symbols: np.ndarray, rare: bool) -> np.ndarray:
        """Twice the next state, plus one where a new phrase begins; without ``rare`` all symbols are in the table."""
        if not rare:
            return self.table[state + symbols]
        found = np.empty(len(state), self.table.dtype)
        common = symbols <= self.pad
        found[common] = self.table[state[common] + symbols[common]]
        state, symbols = state[~common].astype(np.int64), symbols[~common].astype(np.int64)
        move = self._rare(state, symbols)
        new = move < 0
        move[new] = self._rare(np.full(new.sum(), root, np.int64), symbols[new])
        move[move < 0] = root * 2 + 1
        found[~common] = move
        return found

    def _rare(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Moves by rarer letters, -1 where there is none."""
        if not len(self.rare_keys):
            return np.full(len(state), -1, np.int64)
        key = state + symbols * self.rare_step
        at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == key, self.rare_moves[at], -1)


def sample_rows(docs: DataFrame, rows_per_language: int, most_chars: int, salts: int = 8) -> DataFrame:
    """At most ``rows_per_language`` whole texts of each language: those of at most ``most_chars`` characters with the smallest hashes,
    then the shortest of the longer ones.

    Rows without text or lang are no examples, and neither are those whose lang is ``und``. Ranks are taken in salted parts first, so a
    language that holds most rows is not ordered in one task.
    """
    text = F.col("text").cast("string")
    rows = docs.where("text is not null and lang is not null").where(F.col("lang").cast("string") != UNDETERMINED).select(
        F.col("lang").cast("string").alias("lang"),
        text.alias("text"),
        F.greatest(F.length(text) - most_chars, F.lit(0)).alias("over"),
        F.xxhash64("doc_id", "text").alias("place"),
    )
    for keys in (["lang", F.pmod("place", F.lit(salts))], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("over", "place", "text")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language).drop("n")
    return rows.drop("over")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """1 for letters, 2 for marks that belong to letters, by code point."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(_CODES)], np.uint8)


def _automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                clone = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = clone
                    state = link[state]
                link[target] = link[new] = clone
        last = new
    return moves


def fit(texts: dict[str, list[str]], table_letters: int = 200) -> Model:
    """The model of labelled texts; every letter has a class, and the ``table_letters`` most frequent ones lie in the table.

    Fewer do where the table would be larger than ``TABLE_BYTES``; the sorted list of rarer transitions holds one entry for each transition
    at most, so it is bounded by the sample.
    """
    kinds = _letters()
    languages = sorted(texts)
    seen: Counter[str] = Counter()
    for rows in texts.values():
        for text in rows:
            seen.update(c for c in text.lower() if kinds[ord(c)])
    ordered = sorted(seen, key=lambda c: (-seen[c], c))
    # An automaton has at most two states for a character.
    states = 2 * sum(len(text) + 1 for rows in texts.values() for text in rows)
    table_letters = max(1, min(table_letters, TABLE_BYTES // (4 * max(states, 1)) - 3))
    kept, rarer = ordered[:table_letters], ordered[table_letters:]
    other, pad = len(kept) + 1, len(kept) + 2
    width = pad + 1
    number = {c: i + 1 for i, c in enumerate(kept)} | {c: width + i for i, c in enumerate(rarer)}
    classes = np.where(kinds > 0, other, 0).astype(np.min_scalar_type(width + len(rarer)))
    for c, i in number.items():
        classes[ord(c)] = i
        upper = c.upper()
        if len(upper) == 1:
            classes[ord(upper)] = i
    tables, roots, sizes, rare, offset = [], [], [], [], 0
    for language in languages:
        symbols = [
            int(c)
            for text in sorted(texts[language])
            for c in _squeezed(classes[np.frombuffer(("\0" + text).encode("utf-32-le", "replace"), "<u4")])
        ]
        moves = _automaton(symbols)
        root = offset * width
        first = np.full(width, root * 2 + 1, np.int64)
        for symbol, target in moves[0].items():
            if symbol < width:
                first[symbol] = (offset + target) * width * 2 + 1
            else:
                rare.append((symbol, root, (offset + target) * width * 2 + 1))
        block = np.tile(first, (len(moves), 1))
        for state, known in enumerate(moves):
            if state:
                for symbol, target in known.items():
                    if symbol < width:
                        block[state, symbol] = (offset + target) * width * 2
                    else:
                        rare.append((symbol, (offset + state) * width, (offset + target) * width * 2))
            block[state, pad] = (offset + state) * width * 2
        tables.append(block)
        roots.append(root)
        sizes.append(max(2, len(symbols)))
        offset += len(moves)
    table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int64)
    if table.size and table.max() < 2**31:
        table = table.astype(np.int32)
    symbol, state, move = np.array(sorted(rare), np.int64).reshape(-1, 3).T
    step = max(1, offset * width)
    return Model(
        languages, np.array(sizes), classes, kinds, np.array(roots, table.dtype), table, pad, state + symbol * step, move, step
    )


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    """Runs of class 0 become one; a text should begin with one."""
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[:1] = True
    return symbols[keep]


def phrases(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of phrases of each text by language, and whether the text has a letter."""
    codes = np.frombuffer("".join(["\0" + text for text in texts]).encode("utf-32-le", "replace"), "<u4")
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    symbols = model.classes[codes]
    has_letter = np.maximum.reduceat(model.letters[codes] == 1, starts)
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[starts] = True
    lengths = np.add.reduceat(keep, starts, dtype=np.int64)
    symbols = symbols[keep]
    firsts = np.cumsum(lengths) - lengths
    n_blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(texts)), n_blocks)
    block_no = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    size = np.minimum(BLOCK, lengths[owner] - block_no * BLOCK)
    begin = firsts[owner] + block_no * BLOCK
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], begin[order]
    longest = int(size[0]) if len(size) else 0
    grid = np.full((longest, len(size)), model.pad, np.int32)
    for step in range(0, longest, 64):  # 64 rows at a time, so that places of all characters are never held at once
        rows = np.arange(step, min(step + 64, longest))[:, None]
        inside = rows < size[None, :]
        grid[step : step + 64] = np.where(inside, symbols[np.minimum(begin[None, :] + rows, len(symbols) - 1)], model.pad)
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    rare = [bool((grid[step, : active[step]] > model.pad).any()) for step in range(longest)]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # For each block the one before it in its text, -1 for the first.
    before = np.where(block_no > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
    totals = np.zeros((len(texts), len(model.languages)), np.int64)
    for language, root in enumerate(model.roots):
        count = _parsed(model, int(root), grid, size, active, rare, before)
        totals[:, language] = np.bincount(owner[order], count, len(texts))
    return totals, has_letter


def _parsed(model: Model, root: int, grid, size, active, rare, before) -> np.ndarray:
    """Phrases that begin in each block, where texts are parsed from their start.

    Every block is parsed from a new phrase first. A parse that comes from the block before goes on until it begins a phrase where
    the block's own parse does; from there on both are one. Where that does not happen inside the block, the
    state at its end changes, and the next block is looked at again.
    """
    state = np.full(len(size), root, model.table.dtype)
    fresh = np.zeros(grid.shape, bool)
    for step in range(len(grid)):
        n = active[step]
        move = model.moves(root, state[:n], grid[step, :n], rare[step])
        fresh[step, :n] = move & 1
        state[:n] = move >> 1
    count = fresh.sum(axis=0, dtype=np.int64)
    entered = np.full(len(size), root, model.table.dtype)
    own, own_end = count.copy(), state.copy()
    following = np.flatnonzero(before >= 0)
    while True:
        todo = following[state[before[following]] != entered[following]]
        if not len(todo):
            return count
        entered[todo] = state[before[todo]]
        # A parse that starts at a phrase is the block's own one.
        now, carried, passed = entered[todo].copy(), np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64)
        live = np.arange(len(todo))
        step = 0
        while len(live):
            ended = size[todo[live]] <= step
            if ended.any():
                gone = live[ended]
                count[todo[gone]], state[todo[gone]] = carried[gone], now[gone]
                live = live[~ended]
                continue
            at = todo[live]
            move = model.moves(root, now[live], grid[step, at], rare[step])
            begins = (move & 1).astype(bool)
            now[live] = move >> 1
            carried[live] += begins
            passed[live] += fresh[step, at]
            met = begins & fresh[step, at]
            if met.any():
                gone = live[met]
                count[todo[gone]] = own[todo[gone]] - passed[gone] + carried[gone]
                state[todo[gone]] = own_end[todo[gone]]
                live = live[~met]
            step += 1


def _decided(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    """Language and score of each text, and whether it has a letter."""
    if not texts:
        return [], [], []
    totals, has_letter = phrases(model, texts)
    if not model.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts), has_letter.tolist()
    bits = totals * np.log2(model.sizes)
    best = bits.argmin(axis=1)
    if len(model.languages) > 1:
        two = np.partition(bits, 1, axis=1)[:, :2]
        score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    else:
        score = np.ones(len(texts))
    names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, has_letter)]
    return names, np.where(has_letter, np.clip(score, 0, 1), 0.0).tolist(), has_letter.tolist()


def decide(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text.

    The score compares the two best languages: 0 for a tie, 1 where the best needs a vanishing
    share of the bits of the second, or where only one language was learnt. Ties go to the name that comes first.
    """
    names, scores, _ = _decided(model, texts)
    return names, scores


def learn(docs: DataFrame, rows_per_language: int = 24, most_chars: int = 2000) -> Model:
    """A model of ``docs`` (doc_id, text, lang), from ``rows_per_language`` whole texts of each language (fewer where there are more than
    ``SAMPLE_ROWS`` / ``rows_per_language`` languages), of at most ``most_chars`` characters where there are enough such texts."""
    named = docs.where("text is not null and lang is not null").select("lang").distinct().count()
    texts: dict[str, list[str]] = {}
    for row in sample_rows(docs, max(1, min(rows_per_language, SAMPLE_ROWS // max(named, 1))), most_chars).collect():
        texts.setdefault(row.lang, []).append(row.text)
    return fit(texts)


def held_out(doc_id: str = "doc_id"):
    """Whether the document is kept from learning: a third of the ids, and null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def _identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs``, then lang_pred, score and whether the text has a letter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(docs.where(~held_out())))
    width, at = len(docs.columns), docs.columns.index("text")

    def work(batch: pa.RecordBatch):
        texts = [text or "" for text in batch.column(at).to_pylist()]
        return [*batch.columns, *_decided(shared.value, texts)]

    # Names may repeat in docs; the worker's columns are numbered, and named again by the callers.
    numbered = docs.toDF(*[f"c{i}" for i in range(width)])
    schema = ", ".join(f"{name} {kind}" for name, kind in numbered.dtypes)
    return map_batches(numbered, work, schema + ", lang_pred string, score double, lettered boolean", at)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of ``docs`` in their order, then lang_pred and score, for every row.

    Learns from text and lang of rows that are not held out unless a model is given.
    Predictions read the text alone, all of it. Null text, empty text and text
    without a letter give ``und`` with score 0, and so does everything where nothing was
    learnt. Repeated rows repeat; an empty table gives none.
    """
    return _identified(docs, model).drop("lettered").toDF(*docs.columns, "lang_pred", "score")


def known_language(
    docs: DataFrame,
    model: Model | None = None,
    wanted: Collection[str] | None = None,
    least_score: float = 0.0,
) -> DataFrame:
    """The rows of ``docs`` whose text is in a ``wanted`` language (by default any that was learnt), columns unchanged.

    The prediction decides: rows without a letter go, and so do those whose predicted language is not wanted or
    whose score is below ``least_score``. A null ``lang`` becomes the prediction. Where no language was learnt every
    text with a letter stays. Repeated rows stay or go together; an empty table gives none.
    """
    if model is None:
        model = learn(docs.where(~held_out()))
    rows = _identified(docs, model).where("lettered")
    if model.languages:
        known = F.col("score") >= least_score
        rows = rows.where(known if wanted is None else known & F.col("lang_pred").isin(sorted(wanted)))
        at = f"c{docs.columns.index('lang')}"
        rows = rows.withColumn(at, F.coalesce(F.col(at).cast("string"), "lang_pred"))
    return rows.drop("lang_pred", "score", "lettered").toDF(*docs.columns)
