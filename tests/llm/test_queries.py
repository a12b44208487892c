"""Registered queries against their SQL, and the pipeline against its stages in plain Python."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, connect
from wattline.llm import language_id, mixing
from wattline.llm.catalog import ORACLE, QUERIES
from wattline.llm.registry import table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    folder = SMALL if name == "op10_line_dedup" else SF
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def test_pipeline_against_plain_python(spark):
    from tests.llm.test_near import by_hand
    from wattline.llm.pieces import PieceModel
    from wattline.llm.queries_encoding import MODEL

    documents = table(spark, SMALL, "documents")
    rows = {r.doc_id: r for r in documents.collect()}
    kept = [r for r in rows.values() if any(c.isalpha() for c in r.text or "")]
    lower = {}
    for r in kept:
        text = r.text.translate({c: c + 32 for c in range(65, 91)})
        lower[text] = max(lower.get(text, -1), r.doc_id)
    kept = sorted(lower.values())
    components = by_hand([(i, rows[i].text) for i in kept])
    kept = [i for i in kept if components[i][1] == i]
    frame = documents.where(documents.doc_id.isin(kept))
    mix = mixing.mix(frame, table(spark, SMALL, "labels")).collect()
    copies = {r.doc_id: r.epochs + r.selected for r in mix if r.epochs + r.selected}
    got = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert {i: len(n) for i, n in got.items()} == copies
    model = PieceModel(MODEL)
    assert all(set(n) == {len(model.encode(rows[i].text)[0])} for i, n in got.items())


def test_stages_keep_columns(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
        empty = stage(spark, docs.where("false"), SMALL)
        assert empty.columns == docs.columns and empty.count() == 0


def test_language_stage_keeps_what_has_letters(docs, spark):
    frame = docs([(1, "ein Satz", "de"), (2, "42", "de"), (3, None, "en"), (4, "ok", None)], clash=False)
    assert sorted(r.doc_id for r in language_id.known_language(frame).collect()) == [1, 4]


def test_prediction_reaches_the_end_of_the_pipeline(spark, tmp_path):
    """A missing lang is predicted and returned, and a text between two languages goes, though its label names one."""
    documents = table(spark, SMALL, "documents")
    rows = documents.collect()
    unnamed = next(r for r in rows if r.doc_id % 2 and r.lang == "de")
    mixed = "Rethhand thntnd.\nThis work is licensed under the GNU General Public License, version 3 or later."
    changed = [r.asDict() | ({"lang": None} if r.doc_id == unnamed.doc_id else {}) for r in rows]
    changed.append({"doc_id": 10**6, "text": mixed, "lang": "en", "source": rows[0].source, "n_chars": len(mixed)})
    frame = spark.createDataFrame(changed, documents.schema)
    model = language_id.learn(frame.where(~language_id.held_out()))
    (lang,), (score,) = language_id.decide(model, [mixed])
    kept = corpus_pipeline.language(spark, frame, str(tmp_path))
    assert (score < corpus_pipeline.LEAST_SCORE) == (kept.where("doc_id = 1000000").count() == 0)
    one = corpus_pipeline.encoded(spark, kept.where(kept.doc_id == unnamed.doc_id), str(tmp_path)).collect()
    assert [r.lang for r in one] == ["de"]
    between = language_id.known_language(frame, model, least_score=score + 0.01).where("doc_id = 1000000")
    assert between.count() == 0 and language_id.known_language(frame, model, least_score=score).where("doc_id = 1000000").count() == 1
