"""The corpus pipeline: language ID, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattline.llm import encoding, exact_dedup, language_id, mixing, near_dedup
from wattline.llm.queries_encoding import MODEL
from wattline.llm.registry import table
from wattline.session import prepare_session, scratch_path


#: Languages that stay; None for every language that the tables teach.
WANTED: tuple[str, ...] | None = None
#: Share of the bits of the second-best language that the best must save; below it the language of a text is not known.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is not in ``WANTED`` or not sure go, and those without a letter; a missing lang is filled in."""
    return language_id.known_language(docs, wanted=WANTED, least_score=LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; labels of ``sf_dir`` weigh the documents."""
    return mixing.mixed_rows(docs, table(spark, sf_dir, "labels"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids, spans and decoded text of every row, and its language as the first stage left it."""
    return encoding.encoded_digests(docs, MODEL, keep=["lang"])


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: The first stage is a classifier that is trained on the tables, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is stored and read again by the next."""
    prepare_session(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
