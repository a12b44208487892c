"""Hard negatives and whitening against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import negatives
from wattline.llm.negatives import codebook, mine, visit
from wattline.llm.whitening import refined_eigen, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, low=50, high=95):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(e is None or not np.isfinite(e) for e in v):
            continue
        x = [int(np.floor(256.0 * np.float32(e).astype(float))) for e in v]
        kept[i] = min(kept.get(i, (label, x)), (label, x))
    found = set()
    for a, (label, q) in kept.items():
        if a % 50:
            continue
        scored = sorted((-int(np.dot(q, x)), i, other) for i, (other, x) in kept.items() if i != a)
        for neg_p, p, _ in [s for s in scored if s[2] == label][:5]:
            ok = [(-s, i) for s, i, other in scored if other != label and 50 * -neg_p <= 100 * -s <= 95 * -neg_p]
            found |= {(a, p, r + 1, i, -neg_p, s) for r, (s, i) in enumerate(ok[:3])}
    return found


def got(frame):
    rows = frame.collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.fixture
def small_index(monkeypatch):
    """Many cells, shelves, blocks and batches on few rows."""
    for name, value in (("CELL_ROWS", 4), ("SHELF_ROWS", 16), ("BLOCK_ANCHORS", 2), ("FIRST_CELLS", 2), ("_STRIP", 3)):
        monkeypatch.setattr(negatives, name, value)


def test_visit_is_by_falling_sum_and_complete():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 6, rng.integers(1, 7)).astype(float), rng.integers(0, 6, rng.integers(1, 7)).astype(float)
        seen = list(visit(a, b))
        assert {(i, j) for i, j, _ in seen} == {(i, j) for i in range(len(a)) for j in range(len(b))}
        assert len(seen) == len(a) * len(b)
        sums = [s for _, _, s in seen]
        assert sums == sorted(sums, reverse=True) and all(s == a[i] + b[j] for i, j, s in seen)
    assert list(visit(np.array([-np.inf]), np.array([1.0]))) == []


def test_mine_clusters_ties_and_copies(spark, small_index):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 7))
    rows = []
    for i in range(300):
        v = centres[i % 6] + rng.normal(size=7) * 0.2
        rows.append((i, [float(np.float32(round(e, 1))) for e in v], int(rng.integers(0, 3))))
    rows += [(i, [0.5] * 7, i % 4) for i in range(300, 420)]  # copies: ties at every score
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(mine(frame)) == brute(rows)


def test_mine_leaves_out_what_cannot_be_compared(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.7, None], 2), (4, [float("nan"), 1.0], 2),
        (5, None, 2), (6, [0.6, 0.2], None), (7, [], 2), (8, [float("inf"), 0.0], 2), (9, [0.5, 0.5], 2),
        (9, [0.5, 0.5], 2), (None, [0.7, 0.0], 2), (50, [-1.0, 0.0], 3), (51, [0.0, 0.0], 3),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("cell", "shelf", "score", "x", "rank")})
    assert got(mine(frame)) == brute(rows) != set()
    longer = frame.unionByName(spark.createDataFrame([(60, [1.0, 0.0, 0.0], 2)], SCHEMA), allowMissingColumns=True)
    assert got(mine(longer)) == brute(rows)
    assert mine(frame.where("false")).count() == 0
    assert mine(frame.where("vec_id % 50 != 0")).count() == 0


def test_mine_visits_twice_at_most(spark, small_index, monkeypatch):
    """Vectors without structure: the first cells tell what an anchor needs, then all others are seen in one visit."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(np.float32(e)) for e in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(400)]
    stored = []
    kept = negatives.settle

    def settle(spark, frame, label, *rest):
        found = kept(spark, frame, label, *rest)
        stored.append((label, found))
        return found

    monkeypatch.setattr(negatives, "settle", settle)
    assert got(mine(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows) != set()
    asked = [frame for label, frame in stored if label == "requests"]
    shelves = next(frame for label, frame in stored if label == "shelves").select("shelf").distinct().count()
    assert len(asked) == 4 and shelves > 10  # two visits for positives, two for negatives
    assert all(0 < frame.count() <= 8 * shelves for frame in asked)  # one row for each of 8 anchors and shelf


@pytest.mark.parametrize("size", [1.0, 2.0**9, 2.0**17])
def test_mine_is_exact_for_entries_of_any_size(spark, small_index, size):
    """Products that fit single floats, doubles, and neither."""
    rng = np.random.default_rng(13)
    rows = [(i, [float(np.float32(e * size)) for e in rng.normal(size=5)], int(rng.integers(0, 4))) for i in range(160)]
    rows += [(i, rows[i - 160][1], i % 4) for i in range(160, 200)]
    assert got(mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows) != set()


def test_codebook_of_equal_vectors():
    assert len(codebook(np.ones((10, 3)), 4)) == 1


def test_clustered_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal beyond double precision
        q = q + q @ ((np.eye(40) - q.T @ q) / 2)
    values = np.sort(rng.uniform(1, 5, 40))[::-1].astype(np.longdouble)
    values[3], values[4], values[5] = values[2] - 1e-7, values[2] - 2e-7, values[2] - 1e-9
    values[20] = values[21]
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    found, basis = refined_eigen((q * values) @ q.T)
    assert np.abs(found - values).max() < 1e-16 * 10
    alone = [i for i in range(40) if np.delete(np.abs(values - values[i]), i).min() > 0]
    signs = np.sign((q * basis).sum(axis=0))
    assert np.abs(basis * signs - q)[:, alone].max() < 1e-9
    apart = [i for i in alone if np.delete(np.abs(values - values[i]), i).min() > 1e-3]
    assert np.abs(basis * signs - q)[:, apart].max() < 1e-15
    assert np.abs(basis.T @ basis - np.eye(40)).max() < 1e-17 * 20


def test_zero_and_identity_matrices():
    for a in (np.zeros((3, 3)), np.eye(3), np.zeros((0, 0))):
        values, basis = refined_eigen(a)
        assert np.allclose(values.astype(float), np.diag(a)) and np.allclose(basis.astype(float).T @ basis.astype(float), np.eye(len(a)))


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(200, 6)) * [3, 2, 1, 0.5, 0.4, 0.3]
    vectors = [[float(np.float32(e)) for e in v] for v in base]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(1000 + i, vectors[0], 1) for i in range(500)]
    rows += [(2000, None, 1), (2001, [1.0, None, 0, 0, 0, 0], 1), (2002, [float("nan")] * 6, 1), (None, vectors[1], 2), (2003, [1.0], 1), (2004, [], 1)]
    frame = spark.createDataFrame([(i, v and [None if e is None else float(e) for e in v], k) for i, v, k in rows], SCHEMA)
    frame = frame.withColumns({c: F.lit(1) for c in ("x", "n", "at", "value", "component")}).repartition(7)
    result = whiten(frame).collect()
    assert len(result) == 701 * 4 and {r.n for r in result} == {200}
    x = np.floor(256.0 * np.array(vectors)).astype(np.int64)
    sums = x.sum(axis=0)
    cov = np.cov(x.T, bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    by_id = {(r.vec_id, r.component): r for r in result}
    for c in range(4):
        want = (x - sums / 200) @ u[:, c] / np.sqrt(e[c])
        have = np.array([by_id[(i, c + 1)].whitened for i in range(200)])
        assert np.abs(have * np.sign((have * want).sum()) - want).max() < 1e-10
        assert abs(by_id[(0, c + 1)].explained - e[c] / np.trace(cov)) < 1e-12
        assert by_id[(1000, c + 1)].whitened == by_id[(0, c + 1)].whitened
    for i in range(200):
        assert by_id[(i, 1)].deviation == int(((200 * x[i] - sums) ** 2).sum())
    assert {r.identity_error for r in result} == {result[0].identity_error} and result[0].identity_error < 1e-10


def test_whiten_without_variance_large_entries_and_empty(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, [0.5, 0.25], 1)], SCHEMA)
    rows = whiten(same).collect()
    assert len(rows) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained is None for r in rows)
    huge = spark.createDataFrame([(1, [2.0**40, 1.0], 1), (2, [-(2.0**40), 3.0], 1), (3, [0.0, 2.0], 1)], SCHEMA)
    rows = {(r.vec_id, r.component): r for r in whiten(huge).collect()}
    assert rows[(1, 1)].deviation is None and abs(abs(rows[(1, 1)].whitened) - np.sqrt(1.5)) < 1e-9
    assert whiten(same.where("false")).count() == 0
