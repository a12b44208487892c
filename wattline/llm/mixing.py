"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame operations only.

Every document gets the exponential key ``-ln(u) / weight`` of Efraimidis and
Spirakis, with ``u`` from a digest of its id. Within a source the documents are
taken in ascending order of the key until their prefix sum reaches the part of the
target that complete epochs leave over. The prefix sum never orders a whole source
in one task: keys fall into buckets of a bounded expected number of documents, bucket
totals are summed first, and only rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.llm.text import count_words
from wattline.session import settle

#: Expected documents of a bucket at equal weights.
BUCKET_ROWS = 5_000


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the seed and the id (a null id: the text) alone."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(text, F.lit("")), 256)))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, limit: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, n_docs, source_size, target from rows of (source, size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share the
    total size by weight; none takes over ``limit`` times its own size, and what is over
    goes to the others by weight until none is above. Sources sorted by the share
    at which they reach their limit fill up in that order, so the final share per weight
    is the largest of what would be left for each rest of that order.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sizes.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(ranked) - 1)
        .withColumns({"weight": pick, "cap": F.col("source_size") * limit})
        .withColumns(
            {
                "taken_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
                "weight_left": F.sum("weight").over(rest),
                "total": F.sum("source_size").over(whole),
            }
        )
        .withColumn(
            "share", F.max((F.col("total") - F.col("taken_before")).cast("double") / F.col("weight_left")).over(whole)
        )
        .select(
            "source",
            "n_docs",
            "source_size",
            F.least(F.col("cap").cast("double"), F.col("weight") * F.col("share")).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    seed: int = 17,
    limit: int = 3,
    weights: tuple[int, ...] = (1, 2, 3),
    factors: tuple[float, float, float] = (0.5, 1.0, 2.0),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, source, size, source_size, target, epochs, selected, taken.

    ``docs`` has doc_id, source and text; size is the number of words, 0 for null.
    ``quality`` has doc_id and quality (0 or 1): documents weigh ``factors[0]`` where all
    their labels are 0, ``factors[2]`` where one is 1, ``factors[1]`` without label.
    ``epochs`` complete copies come first; then a document is ``selected`` while half of
    it still fits into what is left of the target, so a source misses its target by at
    most half a document. ``taken`` is size times copies, never over ``limit`` times the size.
    Equal keys are ordered by id and size; rows that repeat these are interchangeable. Null
    sources form one source. A source without words takes nothing. Empty tables give no rows.
    """
    low, middle, high = factors
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        count_words(text).alias("size"),
        uniform(F.col("doc_id"), text, seed).alias("u"),
    )
    if quality is not None:
        label = quality.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
            F.max("quality").alias("quality")
        )
        rows = rows.join(label, "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    factor = F.when(F.col("quality") > 0, high).when(F.col("quality") <= 0, low).otherwise(middle)
    keyed = settle(
        docs.sparkSession,
        rows.withColumn("key", -F.log("u") / factor).drop("u", "quality"),
        "mix-keys",
    )
    targets = source_targets(keyed, limit, weights).withColumns(
        {
            "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(
                F.lit(0)
            ),
            "n_buckets": F.ceil(F.col("n_docs") / BUCKET_ROWS),
        }
    )
    # Keys of the smallest weight are even on this scale; larger weights are at most high / low times denser anywhere.
    even = 1 - F.exp(-F.col("key") * min(factors))
    placed = keyed.join(
        targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))
    ).withColumn("bucket", F.least(F.floor(even * F.col("n_buckets")), F.col("n_buckets") - 1))
    totals = (
        placed.groupBy("of", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn(
            "earlier",
            F.sum("bucket_size").over(Window.partitionBy("of").orderBy("bucket")) - F.col("bucket_size"),
        )
        .select(F.col("of").alias("in_source"), F.col("bucket").alias("in_bucket"), "earlier")
    )
    ordered = Window.partitionBy("of", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0
    )
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    selected = F.col("earlier") + F.col("upto") - F.col("size") / 2 <= left
    return (
        placed.withColumn("upto", F.sum("size").over(ordered))
        .join(
            totals,
            F.col("of").eqNullSafe(F.col("in_source")) & (F.col("bucket") == F.col("in_bucket")),
        )
        .withColumn("selected", selected & (left > 0))
        .select(
            "doc_id",
            "text_hash",
            "source",
            "size",
            "source_size",
            "target",
            "epochs",
            "selected",
            (F.col("size") * (F.col("epochs") + F.col("selected").cast("long"))).alias("taken"),
        )
    )


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, columns unchanged.

    Rows that repeat id and text are one document here, taken as often as all of them together. Null texts have no words, and
    are taken with their source like others. Other columns may have any name; an empty table gives no rows.
    """
    copies = (
        mix(docs, quality, seed)
        .groupBy("doc_id", "text_hash")
        .agg(F.sum(F.col("epochs") + F.col("selected").cast("long")).alias("copies"))
        .where("copies > 0")
        .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "copies")
    )
    # Columns of docs are numbered, so that none clashes with those that are joined.
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    hashed = numbered.withColumn("own", F.xxhash64(F.coalesce(F.col(text_at).cast("string"), F.lit(""))))
    return (
        hashed.join(copies, F.col(id_at).eqNullSafe(F.col("id")) & (F.col("own") == F.col("hash")))
        .dropDuplicates(["id", "hash"])
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(*numbered.columns)
        .toDF(*docs.columns)
    )
