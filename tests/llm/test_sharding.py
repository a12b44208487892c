"""Sharding by sampled splitters against a sort of all rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from wattline.llm import sharding
from wattline.llm.sharding import assign, ranges, records, write_shards


def by_hand(rows, n_shards, slack=0.01):
    full = []
    for i, text in rows:
        body = (text or "").encode()
        full.append((hashlib.sha256(body).hexdigest(), (i is not None, i or 0), len(body) + 1, zlib.crc32(body), i))
    full.sort(key=lambda r: r[:2])
    total, at, places, groups = sum(r[2] for r in full), 0, [], {}
    for key, _, size, _, _ in full:
        low, _ = groups.get(key, (at, 0))
        places.append(at)
        at += size
        groups[key] = (low, at)
    ends = []
    for s in range(1, n_shards):
        end = s * total
        for (key, _, size, _, _), before in zip(full, places):
            if before * n_shards < end <= (before + size) * n_shards:
                low, high = (g * n_shards for g in groups[key])
                near = low if end - low <= high - end else high
                ends.append(near if abs(near - end) <= slack * total else end)
    slots, found = Counter(), []
    for (_, _, size, crc, i), before in zip(full, places):
        shard = sum(2 * e <= (2 * before + size) * n_shards for e in ends)
        found.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
    return found


def got(frame):
    return [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in frame.collect()]


def order(row):
    return (row[3], row[4])


@pytest.mark.parametrize("n_shards", [1, 8])
def test_hot_group_copies_nulls_and_long_text(docs, n_shards):
    rows = [(i, f"text number {i} " * (i % 17)) for i in range(300)]
    rows += [(1000 + i, "the same text") for i in range(400)] + [(i, None) for i in range(5000, 5060)]
    rows += [(7, "a repeated row")] * 90 + [(None, "no id")] * 2 + [(9999, "x" * 2000), (8, ""), (8, None)]
    have = got(assign(docs(rows).repartition(9), n_shards, range_bytes=200))
    assert sorted(have, key=order) == by_hand(rows, n_shards)


def test_result_does_not_depend_on_ranges(docs):
    rows = [(i, "w " * (i * 7 % 31)) for i in range(500)]
    results = [sorted(got(assign(docs(rows), 4, range_bytes=b)), key=order) for b in (50, 1 << 20)]
    assert results[0] == results[1] == by_hand(rows, 4)


def test_ranges_are_small_and_ordered(docs, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_OUT", 4)
    rows = [(i, f"t{i}" * (i % 5)) for i in range(2000)] + [(i, "hot") for i in range(5000, 6000)]
    ranged = ranges(records(docs(rows)), 100).collect()
    held = defaultdict(list)
    for r in ranged:
        held[r.range].append(r)
    assert all(sum(r.size * r.copies for r in g) <= 200 or len(g) == 1 for g in held.values())
    keys = [(r.key, r.doc_id) for k in sorted(held) for r in sorted(held[k], key=lambda r: (r.key, r.doc_id))]
    assert keys == sorted(keys)


def test_sizes_are_near_equal_and_groups_whole(docs):
    rows = [(i, f"document {i // 3} " * (1 + i // 3 % 40)) for i in range(6000)]
    have = assign(docs(rows), 8).collect()
    sizes = Counter()
    for r in have:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 8
    shards = defaultdict(set)
    for r in have:
        shards[r.key].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_empty_table_and_text_ids(docs, spark):
    assert assign(docs([(1, "a")]).where("false")).count() == 0
    frame = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert sorted((r.shard, r.slot, r.doc_id) for r in assign(frame, 1).collect()) == [(0, 0, None), (0, 1, "a"), (0, 2, "b")]


def test_written_shards_hold_all_rows(docs, spark, tmp_path):
    rows = [(i, f"text {i % 50} " * (i % 9)) for i in range(400)] + [(5, "twice")] * 3
    write_shards(docs(rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    assert len({(r.shard, r.slot) for r in back}) == len(rows)
