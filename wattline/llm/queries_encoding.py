"""Query for SentencePiece encoding; the library is the reference that the tests compare with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattline.llm.encoding import encoded_digests
from wattline.llm.registry import query, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op5_sentencepiece")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), MODEL)
