"""Exact deduplication and mixing."""

import hashlib
import math

from pyspark.sql import functions as F

from tests.llm.conftest import collected
from wattline.llm import exact_dedup, mixing


def test_exact_dedup_cases(docs):
    long = "Wort " * 50_000
    rows = [(1, "Ab c"), (2, "aB C"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, long), (8, long.upper()), (9, "x")]
    got = collected(exact_dedup.exact_dedup(docs(rows)))
    assert {i: got[i].keep_id for i in got} == {1: 2, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6, 7: 8, 8: 8, 9: 9}
    assert {i for i in got if got[i].kept} == {2, 3, 4, 6, 8, 9}
    assert got[5].group_size == 2 and got[1].text_sha256 == hashlib.sha256(b"ab c").hexdigest()


def test_exact_dedup_repeated_and_null_ids(docs):
    got = exact_dedup.exact_dedup(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (1, "c")])).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in got if r.group_size == 3) == [
        ("1", 1, 3, True), ("None", 1, 3, False)]
    assert [(r.keep_id, r.kept) for r in got if r.doc_id is None and r.group_size == 1] == [(None, True)]
    assert sum(r.kept for r in got) == 3


def test_exact_dedup_hot_group_and_salts(docs):
    rows = [(i, "same TEXT") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(50)]
    for salts in (1, 7):
        got = collected(exact_dedup.exact_dedup(docs(rows), salts=salts))
        assert len(got) == 550 and got[3].keep_id == 499 and got[3].group_size == 500


def test_keep_first_keeps_columns_and_one_row(docs):
    frame = docs([(1, "A"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c")])
    kept = exact_dedup.keep_first(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("2", "a"), ("3", "b"), ("None", "c")]


def test_empty_tables(docs, spark):
    frame = docs([(1, "a")]).where("false")
    assert exact_dedup.exact_dedup(frame).count() == 0
    assert mixing.mix(frame).count() == 0
    assert mixing.mixed_rows(frame).count() == 0


def targets_by_hand(sizes):
    """Reshare until no source is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left, target = set(names), sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over


def test_targets_and_takes(docs):
    rows, i = [], 0
    for source, count in (("a", 600), ("b", 30), ("c", 2), (None, 300), ("Z", 5), ("é", 1)):
        for _ in range(count):
            rows.append((i, "w " * (1 + i % 7), "en", source))
            i += 1
    rows.append((i, None, "en", "a"))
    rows.append((i + 1, " \t ", "en", "empty"))
    got = mixing.mix(docs(rows)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    wanted = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for source, size in sizes.items():
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == size for r in mine)
        assert math.isclose(mine[0].target, wanted[source], rel_tol=1e-12, abs_tol=1e-9)
        assert abs(sum(r.taken for r in mine) - wanted[source]) <= 3.5
        assert all(r.taken <= 3 * r.size for r in mine)
    assert math.isclose(sum(wanted.values()), sum(sizes.values()))


def test_buckets_do_not_change_the_mix(docs, monkeypatch):
    rows = [(i, "w " * (1 + i % 5), "en", "ab"[i % 3 == 0]) for i in range(400)]
    key = lambda frame: sorted((r.doc_id, r.taken) for r in frame.collect())
    whole = key(mixing.mix(docs(rows)))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    assert key(mixing.mix(docs(rows))) == whole


def test_quality_is_taken_first(docs, spark):
    rows = [(i, "w w", "en", "ab"[i % 2]) for i in range(2000)]
    quality = spark.createDataFrame([(i, i // 2 % 2) for i in range(2000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = mixing.mix(docs(rows), quality).where("source = 'a'").groupBy((F.col("doc_id") / 2 % 2).cast("int").alias("q")).agg(
        F.avg(F.col("selected").cast("int")).alias("share")).collect()
    share = {r.q: r.share for r in got}
    assert share[1] > share[0] + 0.2


def test_mixed_rows_repeat_as_taken(docs):
    rows = [(i, "w " * 4, "en", "ab"[i >= 90]) for i in range(100)] + [(5, "w " * 4, "en", "a")]
    frame = docs(rows)
    taken = collected(mixing.mix(frame).groupBy("doc_id").agg(F.sum("taken").alias("taken")))
    counts = collected(mixing.mixed_rows(frame).groupBy("doc_id").count())
    assert {i: r["count"] * 4 for i, r in counts.items()} == {i: r.taken for i, r in taken.items() if r.taken}
    assert mixing.mixed_rows(frame).columns == frame.columns
