"""Line deduplication against all pairs of lines."""

import random

from tests.llm.conftest import collected
from wattline.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edits(r, line, count, letters):
    line = bytearray(line)
    for _ in range(count):
        kind, at = r.randrange(3), r.randrange(len(line) + 1)
        if kind == 0:
            line.insert(at, r.choice(letters))
        elif line:
            at %= len(line)
            if kind == 1:
                del line[at]
            else:
                line[at] = r.choice(letters)
    return bytes(line)


def test_banded_distance():
    r = random.Random(5)
    pairs = []
    for _ in range(2000):
        a = bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 14)))
        pairs.append((a, edits(r, a, r.randrange(5), b"ab\0")))
    for most in (1, 2, 3):
        assert ld.within_distance(pairs, most).tolist() == [distance(a, b) <= most for a, b in pairs]


def test_every_near_pair_meets_under_a_key():
    import numpy as np

    r = random.Random(7)
    for _ in range(600):
        a = bytes(r.choice(b"abc") for _ in range(r.randrange(ld.LEAST, 40)))
        b = edits(r, a, ld.DISTANCE, b"abc")
        if len(b) < ld.LEAST:
            continue
        data = np.frombuffer(a + b"\n" + b + b"\n", np.uint8)
        keys = ld.line_keys(data, np.array([0, len(a) + 1]), np.array([len(a), len(b)]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def by_hand(rows):
    lines = {}
    for i, text in rows:
        for k, line in enumerate((text or "").encode().split(b"\n")):
            lines.setdefault((i, k), line)
    different = sorted({l for l in lines.values() if l.strip()})
    root = {l: l for l in different}

    def find(l):
        while root[l] != l:
            l = root[l]
        return l

    for x, a in enumerate(different):
        for b in different[x + 1 :]:
            if min(len(a), len(b)) >= ld.LEAST and abs(len(a) - len(b)) <= ld.DISTANCE and distance(a, b) <= ld.DISTANCE:
                root[find(b)] = find(a)
    first = {}
    for place in sorted(lines):
        if lines[place].strip():
            first.setdefault(find(lines[place]), place)
    kept = {p for p, l in lines.items() if not l.strip() or first[find(l)] == p}
    return {i: [l.decode() for (d, k), l in sorted(lines.items()) if d == i and (d, k) in kept] for i, _ in rows}


def corpus():
    r = random.Random(9)
    bases = ["".join(r.choice("abcdé ") for _ in range(r.randrange(15, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 6)):
            line = list(r.choice(bases))
            for _ in range(r.randrange(4)):
                line[r.randrange(len(line))] = r.choice("abx")
            lines.append("".join(line))
        rows.append((i, "\n".join(lines + [""] * r.randrange(3))))
    return rows + [(70, None), (71, ""), (72, " \n \n"), (73, "short"), (74, "shirt"), (75, "The very common line, for all."),
                   *[(80 + i, "The very common line, for all.") for i in range(60)]]


def test_against_all_pairs(docs):
    rows = corpus()
    wanted = by_hand(rows)
    texts = collected(ld.without_copies(docs(rows)))
    assert {i: t.text for i, t in texts.items()} == {i: "\n".join(lines) for i, lines in wanted.items()}
    report = collected(ld.line_report(docs(rows)))
    for i, text in rows:
        r = report[i]
        assert (r.n_lines, r.n_kept, r.kept_bytes) == (
            (text or "").count("\n") + 1, len(wanted[i]), sum(len(l.encode()) for l in wanted[i]))
        assert r.n_equal + r.n_near == r.n_lines - r.n_kept
    assert report[120].n_equal == 1 and report[73].n_kept == report[74].n_kept == 1


def test_long_lines_repeated_rows_and_empty(docs):
    line = "0123456789" * 9_000
    rows = [(1, line), (2, line + "x"), (3, "y" + line[:-1]), (4, line + "xyz"), (None, line), (5, "some line of its own\nb"), (5, "some line of its own\nb")]
    report = ld.line_report(docs(rows)).collect()
    assert len(report) == 6
    by = {r.doc_id: r for r in report}
    assert by[None].n_kept == 1 and [by[i].n_kept for i in (1, 2, 3)] == [0, 0, 0] and by[1].n_equal == 1
    assert (by[5].n_lines, by[5].n_kept) == (2, 2)
    assert ld.line_report(docs(rows).where("false")).count() == 0


def test_copies_around_an_original(docs):
    """Many lines share a segment and are too far apart; some pairs among them are links."""
    r = random.Random(11)
    base = "".join(r.choice("abcdefgh ") for _ in range(150))
    rows = [(0, base)]
    for i in range(1, 120):
        line = list(base)
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(0, 140)
            line[at : at + 4] = r.choice(["wxyz", "w", "wxyzv"])
        rows.append((i, "".join(line)))
        if i % 5 == 0:
            rows.append((1000 + i, "".join(line)[:-1] + "!"))
    wanted = by_hand(rows)
    report = collected(ld.line_report(docs(rows)))
    assert {i: r.n_kept for i, r in report.items()} == {i: len(lines) for i, lines in wanted.items()}


def test_many_lines_around_one_original_are_not_compared_in_pairs(docs, monkeypatch):
    """5 000 lines made from one original, each by the removal or exchange of words: most are no links."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(4, 9))) for _ in range(400)]
    base = [r.choice(words) for _ in range(40)]
    rows = []
    for i in range(5000):
        line = list(base)
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(line))
            if r.random() < 0.5:
                line[at] = r.choice(words)
            else:
                del line[at]
        text = " ".join(line)
        rows.append((i, text))
        if i % 50 == 0:
            rows.append((100_000 + i, text[:30] + "#" + text[30:]))
    compared = []
    counted = ld.map_batches

    def watched(frame, work, schema, *rest, **options):
        if schema.startswith("a struct"):
            compared.append(frame.count())
        return counted(frame, work, schema, *rest, **options)

    monkeypatch.setattr(ld, "map_batches", watched)
    report = collected(ld.line_report(docs(rows, clash=False).repartition(8)))
    assert sum(compared) < 20 * len(rows)  # of 13 million pairs
    first = {}
    for i, text in rows:
        first.setdefault(text, i)
    assert all(report[100_000 + i].n_kept == 0 for i in range(0, 5000, 50))
    # Against all pairs for some of the lines.
    lines = sorted(first)
    for text in r.sample(lines, 12):
        near = ld.within_distance([(text.encode(), other.encode()) for other in lines])
        ids = [first[o] for o, ok in zip(lines, near) if ok]
        assert sum(report[i].n_kept for i in ids) <= 1
        if len(ids) == 1:
            assert report[ids[0]].n_kept == 1


def test_marks_of_linked_lines_are_near():
    import numpy as np

    r = random.Random(17)
    for _ in range(400):
        a = bytes(r.choice(b"abc \xc3\xa9") for _ in range(r.randrange(1, 60)))
        b = edits(r, a, ld.DISTANCE, b"abcd")
        odd = [int(x).bit_count() for x in (ld._marks(a) ^ ld._marks(b)).view(np.uint64)]
        for size in range(1, ld.GRAM + 1):
            assert sum(o for o, (of, _) in zip(odd, ld.MARKS) if of == size) <= 2 * size * ld.DISTANCE


def test_small_changes_of_one_original(docs):
    """Lines that differ from a missing original by one letter each are links, though what they change has nothing in common."""
    r = random.Random(19)
    base = "".join(r.choice("abcdefgh ") for _ in range(90)).replace("\n", " ")
    # The smallest lines of the keys, and the ones nearest to the original, are no links of the others.
    rows = [(1, "xyz" + base[3:]), (90, base[:-3] + "xyz")]
    rows += [(100 + at, base[:at] + "#" + base[at + 1 :]) for at in range(5, 85, 7)]
    wanted = by_hand(rows)
    report = collected(ld.line_report(docs(rows)))
    assert {i: r.n_kept for i, r in report.items()} == {i: len(lines) for i, lines in wanted.items()}
    assert sum(len(lines) for lines in wanted.values()) == 3


def test_words_grown_in_one_original_are_not_compared_in_pairs(docs, monkeypatch):
    """Lines of one original, in each of which a word got four letters more: they share the ends of words, but are no links."""
    r = random.Random(23)
    words = ["".join(r.choice("abcdehimnorst") for _ in range(r.randrange(1, 4))) + r.choice(["the", "on", "ed", "in"]) for _ in range(80)]
    rows = []
    for i in range(900):
        line = list(words)
        at = r.randrange(len(line))
        line[at] += "".join(chr(97 + r.randrange(26)) for _ in range(4))
        rows.append((i, " ".join(line)))
    compared = []
    counted = ld.map_batches

    def watched(frame, work, schema, *rest, **options):
        if schema.startswith("a struct"):
            compared.append(frame.count())
        return counted(frame, work, schema, *rest, **options)

    monkeypatch.setattr(ld, "map_batches", watched)
    report = collected(ld.line_report(docs(rows, clash=False).repartition(8)))
    assert sum(compared) < 12 * len(rows)  # of 400 000 pairs
    lines = {text.encode(): i for i, text in reversed(rows)}
    different = sorted(lines)
    pairs = [(a, b) for x, a in enumerate(different) for b in different[x + 1 :]]
    near = [pair for pair, ok in zip(pairs, ld.within_distance(pairs)) if ok]
    root = {line: line for line in different}
    for a, b in near:
        old, new = root[a], root[b]
        root = {line: new if top == old else top for line, top in root.items()}
    assert sum(row.n_kept for row in report.values()) == len(set(root.values()))
