"""Query for language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.lm_scoring import score_texts
from wattline.llm.registry import query, table


@query("op8_lm_score")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
