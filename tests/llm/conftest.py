import pytest

#: Names that operators use inside; tables may have them too.
CLASHING = ("content", "key", "size", "kept", "n", "text_hash", "lang_pred", "component_id", "bucket", "words")


@pytest.fixture
def docs(spark):
    """documents-like tables of (doc_id, text[, lang, source]) tuples, with clashing extra columns."""

    def build(rows, clash=True):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        from pyspark.sql import functions as F

        return frame.withColumns({c: F.lit(7) for c in CLASHING}) if clash else frame

    return build


def collected(frame, key="doc_id"):
    return {row[key]: row for row in frame.collect()}
