"""Cross-parsing language identification."""

import random

import numpy as np
import pytest

from tests.llm.conftest import collected
from wattline.llm import language_id as lid
from wattline.llm.registry import table

TEXTS = {
    "en": ["the cat sat on the mat and the dog ran to the house in the rain"] * 3,
    "de": ["der hund und die katze sind nicht im haus und das ist schön für uns"] * 3,
}


def phrases_by_hand(samples, text, model):
    """Longest phrases that occur in the sample, by substring search over the whole text."""
    def squeeze(t):
        s = "".join(chr(c + 1) for c in model.classes[[ord(c) for c in t]])
        while "\1\1" in s:
            s = s.replace("\1\1", "\1")
        return s

    sample = "".join(squeeze("\0" + t) for t in sorted(samples))
    text, count = squeeze("\0" + text), 0
    at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        count += 1
    return count


def test_phrases_against_substring_search(monkeypatch):
    model = lid.fit(TEXTS)
    r = random.Random(2)
    texts = ["", "the", "THE CAT", "zzz", "...", "schön", "12 34", "a" * 40] + [
        "".join(r.choice("thecat derund.ö1 \n") for _ in range(r.randrange(200))) for _ in range(40)]
    # Long texts whose phrases run over the ends of blocks, one of a single letter and some that repeat the sample.
    texts += ["".join(r.choice([*"thedrun. ", "the dog ran to the house ", "nicht im haus und das "]) for _ in range(900)) for _ in range(4)]
    texts += ["a" * 3000, TEXTS["en"][0] * 60, "\0".join(TEXTS["de"]) * 30]
    for block in (1024, 16, 1):
        monkeypatch.setattr(lid, "BLOCK", block)
        found, lettered = lid.phrases(model, texts)
        for k, language in enumerate(model.languages):
            assert found[:, k].tolist() == [phrases_by_hand(TEXTS[language], t, model) for t in texts]
        assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_a_phrase_longer_than_blocks(monkeypatch):
    """A text that is the sample itself has one phrase, however many blocks it fills."""
    sample = "".join(random.Random(4).choice("abcdefgh ") for _ in range(5000))
    model = lid.fit({"en": [sample], "de": TEXTS["de"]})
    for block in (1024, 100):
        monkeypatch.setattr(lid, "BLOCK", block)
        found, _ = lid.phrases(model, [sample, sample + "zz", "qq" + sample, sample[2500:] + sample[:2500]])
        assert [found[i, 1] for i in range(4)] == [phrases_by_hand([sample], t, model) for t in (sample, sample + "zz", "qq" + sample, sample[2500:] + sample[:2500])]
        assert found[0, 1] == 1


def test_many_languages_with_many_letters_fit():
    r = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(3000)]
    texts = {f"l{k}": ["".join(r.choice(letters) for _ in range(400)) for _ in range(6)] for k in range(50)}
    model = lid.fit(texts)
    assert model.table.nbytes <= lid.TABLE_BYTES and model.rare_keys.nbytes + model.rare_moves.nbytes < lid.TABLE_BYTES
    asked = [texts[f"l{k}"][0][100:160] for k in range(0, 50, 7)]
    assert lid.decide(model, asked)[0] == [f"l{k}" for k in range(0, 50, 7)]


def test_the_prediction_decides(docs):
    rows = [(2 * i + k, TEXTS[l][0], l) for i in range(60) for k, l in enumerate(TEXTS)] + [(904, "das Haus ist schön", None), (905, "...", "de")]
    frame = docs(rows)
    model = lid.fit(TEXTS)
    only = lid.known_language(frame, model, wanted=["de"])
    assert only.columns == frame.columns
    assert {(r.doc_id, r.lang) for r in only.collect()} == {(i, "de") for i, _, l in rows[:-2] if l == "de"} | {(904, "de")}
    assert lid.known_language(frame, model, least_score=1.1).count() == 0
    assert lid.known_language(frame, model).count() == len(rows) - 1


def test_cases(docs):
    rows = [(i, TEXTS[l][0], l) for i in range(60) for l in TEXTS]
    rows = [(2 * i + k, *r[1:]) for k, i, r in ((j % 2, j // 2, r) for j, r in enumerate(rows))]
    rows += [(901, None, "en"), (902, "", "en"), (903, "12 .. 7", "de"), (904, "das Haus ist schön", None), (None, "the cat", "en"), (904, "das Haus ist schön", None)]
    frame = docs(rows)
    got = lid.identify(frame).toDF(*frame.columns[:-1], "words", "pred", "score").collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r.pred for r in got}
    assert by[(901, None)] == by[(902, "")] == by[(903, "12 .. 7")] == "und"
    assert by[(904, "das Haus ist schön")] == "de" and by[(None, "the cat")] == "en"
    kept = lid.known_language(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 3
    assert lid.identify(frame.where("false")).count() == 0


def test_nothing_to_learn_from(docs):
    assert {r.lang_pred for r in lid.identify(docs([(1, "text", None)], clash=False)).collect()} == {"und"}


def test_sample_is_bounded_and_whole_table_is_seen(docs):
    frame = docs([(i, f"text {i}", "en") for i in range(300)], clash=False)
    rows = lid.sample_rows(frame, 10, 6).collect()
    assert len(rows) == 10 and {len(r.text) for r in rows} == {6}
    assert sorted(rows) == sorted(lid.sample_rows(frame.repartition(5), 10, 6, salts=3).collect())
    longer = lid.sample_rows(frame, 250, 6).collect()
    assert len(longer) == 250 and {r.text for r in longer} <= {f"text {i}" for i in range(300)} and max(len(r.text) for r in longer) == 8


@pytest.mark.parametrize("sf", ["0.01"])
def test_held_out_accuracy(spark, sf):
    from wattline.llm.catalog import QUERIES

    folder = f"/root/testdata/sf{sf}"
    got = collected(QUERIES["op2_language_id"](spark, folder))
    truth = [(r.lang, got[r.doc_id]) for r in table(spark, folder, "documents").select("doc_id", "lang").collect()]
    held = [lang == g.lang_pred for lang, g in truth if g.held_out]
    assert len(got) == len(truth) and np.mean(held) > 0.98


def test_rare_letters_have_classes_of_their_own():
    """Two languages whose letters are beyond those of the table, in the same word lengths."""
    r = random.Random(8)
    words = {name: ["".join(chr(0x4E00 + side + r.randrange(600)) for _ in range(3)) for _ in range(200)] for side, name in ((0, "aa"), (600, "bb"))}
    texts = {"en": TEXTS["en"] * 40, **{name: ["".join(r.choice(words[name]) for _ in range(10)) for _ in range(120)] for name in words}}
    for size in (200, 20):
        model = lid.fit(texts, size)
        # Words of letters that are not among the most frequent of all.
        rare = [[w for w in words[name] if all(model.classes[ord(c)] > model.pad for c in w)] for name in words]
        asked = ["".join(r.choice(some) for _ in range(10)) for some in rare for _ in range(10)]
        assert lid.decide(model, asked)[0] == ["aa"] * 10 + ["bb"] * 10
        mixed = asked[:3] + [t[:15] + " the cat " + t[15:] for t in asked[:3] + texts["aa"][:3]] + texts["bb"][:3]
        found, _ = lid.phrases(model, mixed)
        for k, language in enumerate(model.languages):
            assert found[:, k].tolist() == [phrases_by_hand(texts[language], t, model) for t in mixed]


def test_documents_stay_where_nothing_was_learnt(docs):
    rows = [(i, f"clean text {i}", None) for i in range(20)] + [(30, "42 .", None), (31, None, None)]
    assert sorted(r.doc_id for r in lid.known_language(docs(rows)).collect()) == list(range(20))


def test_the_name_und_is_no_language(docs):
    frame = docs([(i, "the cat and the dog", "und") for i in range(20)] + [(20 + i, "das Haus", "de") for i in range(20)], clash=False)
    assert lid.learn(frame).languages == ["de"]
    assert lid.known_language(frame).count() == 40
