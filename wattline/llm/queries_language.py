"""Query for language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.language_id import held_out, identify, learn
from wattline.llm.registry import query, table


@query("op2_language_id")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    rows = identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
