"""Winnowing against a direct form, and the comparison with the next document."""

import hashlib
import random

import numpy as np

from tests.llm.conftest import collected
from wattline.llm import winnowing as w


def by_hand(text):
    """(hash, position) pairs, or None for a text shorter than a run."""
    if 0 < len(text) < w.GRAM:
        return None
    hashes = []
    for at in range(len(text) - w.GRAM + 1):
        value = 0
        for c in text[at : at + w.GRAM]:
            value = (value * w._BASE + ord(c) + 1) % 2**64
        hashes.append(int(w.mix64(np.array([value], np.uint64))[0]))
    chosen = []
    for start in range(max(1, len(hashes) - w.WINDOW + 1) if hashes else 0):
        window = range(start, min(start + w.WINDOW, len(hashes)))
        least = min(hashes[j] >> 24 for j in window)
        at = max(j for j in window if hashes[j] >> 24 == least)
        if not chosen or chosen[-1][1] != at:
            chosen.append((hashes[at], at))
    return chosen


def sample():
    r = random.Random(1)
    sizes = [0, 1, 5, 15, 16, 17, 30, 31, 32, 33, 100, 400]
    return ["".join(r.choice("ab \né😀") for _ in range(r.choice(sizes))) for _ in range(200)] + ["a" * 100, "ab" * 60]


def test_winnow_against_direct_form(monkeypatch):
    for limit in (w.LIMIT, 64):
        monkeypatch.setattr(w, "LIMIT", limit)
        for text, (hashes, places) in zip(sample(), w.winnow(sample())):
            wanted = by_hand(text)
            if wanted is None:
                assert len(hashes) == 1 and places.tolist() == [0]
            else:
                assert list(zip(hashes.tolist(), places.tolist())) == wanted


def test_shared_runs_share_a_fingerprint():
    r = random.Random(2)
    for _ in range(50):
        run = "".join(r.choice("abcd") for _ in range(w.GRAM + w.WINDOW - 1))
        one, other = ("".join(r.choice("efgh") for _ in range(r.randrange(80))) for _ in range(2))
        a, b = w.winnow([one + run + other, other + run + one])
        assert set(a[0].tolist()) & set(b[0].tolist())


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", by[i]
        new = w.edited(text, following)
        a, b, c = w.winnow([text, new, following])
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (w.digest(a), w.digest(b))
        assert r.near_edited == w.likeness(np.unique(a[0]), np.unique(b[0]))
        assert r.near_next == w.likeness(np.unique(a[0]), np.unique(c[0]))


def test_next_documents(docs):
    r = random.Random(6)
    rows = [(i * i - 900, text) for i, text in enumerate(sample())]
    rows += [(10**9, None), (10**9 + 1, ""), (10**9 + 2, "long " * 60_000), (None, "null id " * 9)]
    r.shuffle(rows)
    check(rows, w.compared_with_next(docs(rows).repartition(5)).collect())


def test_one_row_no_row_and_repeated_rows(docs):
    check([(4, "alone " * 20)], w.compared_with_next(docs([(4, "alone " * 20)])).collect())
    assert w.compared_with_next(docs([(4, "x")]).where("false")).count() == 0
    same = w.compared_with_next(docs([(4, "same " * 20)] * 3 + [(5, "same " * 20)])).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same}) == 1 and {r.near_next for r in same} == {1.0}


def test_fingerprints(docs):
    got = collected(w.fingerprints(docs([(1, "some text " * 30), (2, None), (3, "ab")])))
    hashes, places = w.winnow(["some text " * 30])[0]
    assert got[1].positions == places.tolist() and [h % 2**64 for h in got[1].hashes] == hashes.tolist()
    assert got[2].hashes == [] and got[3].positions == [0]


def test_query_on_whole_table(spark):
    from wattline.llm.catalog import QUERIES
    from wattline.llm.registry import table

    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    check(rows, QUERIES["op6_winnowing"](spark, "/root/testdata/sf0.001").collect())
