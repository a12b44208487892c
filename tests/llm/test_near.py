"""Near-duplicates against all pairs, and the sketches."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import collected
from wattline.llm import graphs, hashing, near_dedup


def by_hand(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed, count):
    r = random.Random(seed)
    base = [f"w{r.randrange(60)}" for _ in range(r.choice([6, 30, 120]))]
    for _ in range(count):
        words = list(base)
        for _ in range(r.randrange(5)):
            words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
        yield r.choice([" ", "  ", "\n", "\t"]).join(words)


def test_against_all_pairs(docs):
    rows, i = [], 100
    for seed in range(12):
        for text in variants(seed, 15):
            rows.append((i, text))
            i -= 1 if i % 7 else -300
    rows += [(5001, None), (5002, ""), (5003, " \n"), (5004, "One two"), (5005, "one TWO"), (5006, "Ä b c d e f"), (5007, "ä b c d e f")]
    rows = list({r[0]: r for r in rows}.values())
    got = collected(near_dedup.near_duplicates(docs(rows)))
    wanted = by_hand(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == wanted
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_copies_around_an_original_that_are_too_far_apart(docs):
    """Copies link with the original or with nothing; the second round compares few pairs."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = list(base)
        for _ in range(r.randrange(1, 9)):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = collected(near_dedup.near_duplicates(docs(rows)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == by_hand(rows)


def test_a_large_group_around_a_lost_original_is_not_compared_in_pairs(docs, monkeypatch):
    """Most copies are reached through those that differ least from what all have in common."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in r.sample(range(150), 3 if i < 225 else 1):  # the ones that link all others have the largest ids
            words[at] = f"w{r.randrange(150)}"
        rows.append((i, " ".join(words)))
    found, verified = [], near_dedup._verified

    def counting(sets, pairs):
        found.append(pairs.count())
        return verified(sets, pairs)

    monkeypatch.setattr(near_dedup, "_verified", counting)
    got = collected(near_dedup.near_duplicates(docs(rows)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == by_hand(rows)
    assert len({x.component_id for x in got.values()}) < 5 and sum(found[1:]) < 12 * len(rows)


def test_nulls_repeats_long_and_empty(docs):
    long = " ".join(f"a{i}" for i in range(60_000))
    rows = [(3, long), (4, long + " b"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f")]
    got = near_dedup.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got) == [
        (0, None, True), (3, 3, True), (4, 3, False), (7, 7, True), (8, 7, False)]
    assert near_dedup.near_duplicates(docs(rows).where("false")).count() == 0
    kept = near_dedup.keep_one(docs(rows))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7, 7] and kept.columns == docs(rows).columns


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 900):
        assert (near_dedup.sketch(r.integers(0, 2**63, n).astype(np.uint64), np.array([n]), 128) != 2**64 - 1).all()
    errors = []
    for _ in range(40):
        pool = r.integers(0, 2**63, 400).astype(np.uint64)
        a, b = pool[:350], pool[50:]
        s = near_dedup.sketch(np.concatenate([a, b]), np.array([350, 350]), 128)
        errors.append((s[0] == s[1]).mean() - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = (b"Some words\tand " + bytes([0xC3, 0x84]) + b" more \n" * 3) * 20
    whole, counts = hashing.word_hashes([text, b"", b"x" * 300, b"some WORDS"])
    monkeypatch.setattr(hashing, "PIECE", 64)
    hashing._powers.cache_clear()
    cut, again = hashing.word_hashes([text, b"", b"x" * 300, b"some WORDS"])
    hashing._powers.cache_clear()
    assert (whole == cut).all() and (counts == again).all() and counts[1] == 0
    assert (whole[-2:] == whole[:2]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    assert {r.component for r in graphs.components(edges).collect()} == {0}
    assert graphs.components(edges.where("false")).count() == 0
