"""Chat formatting: exact round trips and typed parts."""

import hashlib
import random

from hypothesis import given, settings, strategies as st

from tests.llm.conftest import collected
from wattline.llm import chat

HARD = st.lists(
    st.sampled_from([*"\\<|>\n aé", "<|end|>\n", "<|turn|>", "<\\|", "\\### Assistant: </turn> ok"]), max_size=12
).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=5))
def test_marks_in_texts_come_back(turns):
    output = "".join(chat.format_turn(role, [{"type": "text", "text": text}])[0] for role, text in turns)
    found = [tuple(map(chat.unescape, m)) for m in chat._MARKED.findall(output)]
    assert found == turns
    assert "".join(m.group() for m in chat._MARKED.finditer(output)) == output


def by_hand(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return {
        c: (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            sum(len(t) for r, t in turns if r == "assistant"),
            hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest(),
        )
        for c, turns in out.items()
    }


def test_read_back(spark):
    r = random.Random(1)
    pieces = ["<|", "|>", "\\", "a", "é", "\n", "<|end|>\n", "😀"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), "".join(r.choices(pieces, k=r.randrange(9))) or None)
            for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (99, 0, "assistant", "long " * 50_000)]
    rows += [(98, t, "assistant", "turn") for t in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = collected(chat.read_back(chat.format_turns(frame.selectExpr("*", "7 as output", "8 as tie"))), "conv_id")
    wanted = by_hand(rows)
    assert {c: (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) for c, g in got.items()} == wanted
    assert got[99].formatted_chars == 250_000 + len(chat.TURN + "assistant" + chat.TEXT + chat.END)
    assert chat.read_back(chat.format_turns(frame.where("false"))).count() == 0


def test_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results = {tuple(chat.read_back(chat.format_turns(frame.repartition(n))).first()) for n in (1, 2, 4)}
    assert len(results) == 1 and results.pop()[1] == 4


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "text", "text": "and"},
        {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "video", "ref": "d.mp4"}, {"type": "image", "ref": None},
    ]
    output, start, end, attached = chat.format_turn("assistant", parts)
    assert output[start:end] == "see <\\|image:0|> <|image:0|><|audio:1|>and<|document:2|><|other:3|><|image:4|>"
    assert [(a["kind"], a["ref"], a["place"], a["tokens"]) for a in attached] == [
        ("image", "a.png", 0, 3), ("audio", "b.wav", 1, 38), ("document", "c.pdf", 2, 1500), ("other", "d.mp4", 3, 0), ("image", None, 4, 0)]
    frame = spark.createDataFrame([(1, 0, "assistant", [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]),
                                   (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    formatted = collected(chat.format_turns(frame), "turn")
    assert formatted[0].output == output and formatted[0].attachment_tokens == 1541 and formatted[1].attachments == []
    assert chat.read_back(chat.format_turns(frame)).first().n_attachments == 5
