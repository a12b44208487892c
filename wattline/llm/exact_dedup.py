"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Equal texts are found in three steps, each of which groups by the digest and by
the full content, so that texts with one digest never merge unless they are equal:
Spark's map-side aggregation combines the copies inside a task, a salted group
combines up to ``salts`` partial winners per text, and the last step combines the
salt winners. A text with billions of copies therefore reaches the last step as at
most ``salts`` rows. Only ids and digests take part in the join back to the rows;
adaptive execution splits the partition of a hot digest there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline.llm.joins import by_ids
from wattline.llm.text import lower_ascii
from wattline.session import settle


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(text).alias("content"))
    return rows.withColumn("text_sha256", F.sha2("content", 256))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per different text: text_sha256, keep_id (largest id), group_size.

    Two different texts with one SHA-256 digest, of which none are known, stop the
    run: the digest is the key of what follows, and merging them would lose a text.
    """
    salted = (
        _digested(docs, id_col, text_col)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_sha256", "content", "salt")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    texts = (
        salted.repartition("text_sha256")
        .groupBy("text_sha256", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    return (
        texts.groupBy("text_sha256")
        .agg(
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.count(F.lit(1)).alias("n_texts"),
        )
        .select(
            "text_sha256",
            "keep_id",
            F.when(F.col("n_texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts have the same SHA-256 digest")).cast("long"))
            .alias("group_size"),
        )
    )


def _decisions(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """``exact_dedup`` with ``n_rows``, the number of rows of each document."""
    rows = (
        _digested(docs, id_col, text_col)
        .select("doc_id", "text_sha256")
        .groupBy("doc_id", "text_sha256")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return rows.join(winners(docs, id_col, text_col, salts), "text_sha256").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text.
    The largest id of a group stays. A document is a pair of id and text: rows that
    repeat both give one row here, but count in ``group_size``. A null id stays only where
    its group has no other id. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    return _decisions(docs, id_col, text_col, salts).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, all columns unchanged; one row per kept document.

    Only documents that lose a row are joined back: those dropped, and those whose row is repeated. Null counts as the empty text; of
    rows that repeat id and text any one stays. Other columns may have any name; an empty table gives no rows.
    """
    changed = settle(
        docs.sparkSession,
        _decisions(docs, id_col, text_col, salts)
        .where("not kept or n_rows > 1")
        .select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha256"), "kept"),
        "exact-changed",
    )
    # Columns of docs are numbered, so that none clashes with those that are joined.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = numbered.withColumn("digest", F.sha2(lower_ascii(F.coalesce(F.col(text_at).cast("string"), F.lit(""))), 256))
    same = F.col(id_at).eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sha256"))
    untouched = rows.join(by_ids(changed.drop("kept")), same, "left_anti").select(*numbered.columns)
    repeated = rows.join(by_ids(changed.where("kept").drop("kept")), same).dropDuplicates(["id", "sha256"]).select(*numbered.columns)
    return untouched.union(repeated).toDF(*docs.columns)
