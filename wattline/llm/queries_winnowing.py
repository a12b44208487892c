"""Query for document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm.registry import query, table
from wattline.llm.winnowing import compared_with_next


@query("op6_winnowing")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))
