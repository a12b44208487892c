"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by a key, the digest of their text and then the id, so equal texts are neighbours.
Splitters cut that order into ranges: keys are sampled with a chance in proportion to their bytes, and the
quantiles of the sample become boundaries. The bytes of each range are then counted over all
records; a range that came out overfull gets its own sample and is subdivided, until every range is small or
holds one key. A sampled key is a range of its own where it is heavy, since each
splitter separates what is below, on and above it. Ranges decide how the work is spread; with the
exact bytes of all earlier ranges, a shard ends where the prefix sum reaches its share of all bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.llm.joins import by_ids
from wattline.session import settle

#: Bytes of records that one range is meant to hold; over ``MOST_RANGES`` times that, ranges grow instead.
RANGE_BYTES, MOST_RANGES = 64 << 20, 100_000
#: Children and sampled keys per child of a range that is cut.
FAN_OUT, DRAWS = 64, 24
#: Bits that a level takes in the number of a range; two boundaries a splitter.
_LEVEL_BITS, _LEVELS = 7, 8
#: Copies of one record that a generated array may hold.
_STRIP = 10_000


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, size, text_crc32, copies, range: one row per different record (id and text), all in one range."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(text, 256).alias("key"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "key", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("range", F.lit(0).cast("long"))
    )


def _place() -> Column:
    return F.struct("key", "doc_id")


def _sample(ranged: DataFrame, full: DataFrame, seed: int) -> DataFrame:
    """range and the splitters of each overfull range: quantiles of a sample weighted by bytes."""
    spread = F.concat_ws(":", F.lit(str(seed)), "key", F.col("doc_id").cast("string"))
    even = (F.pmod(F.xxhash64(spread), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    drawn = F.floor(F.col("bytes") * (F.col("parts") * DRAWS) / F.col("range_bytes") + even)
    samples = (
        ranged.withColumn("bytes", F.col("size") * F.col("copies"))
        .join(F.broadcast(full), "range")
        .withColumn("drawn", drawn)
        .where("drawn > 0")
        .groupBy("range", "parts")
        .agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat(_place(), F.col("drawn").cast("int"))))).alias("seen"))
    )
    at = lambda i: F.col("seen")[F.floor(i * F.size("seen") / F.col("parts")).cast("int")]
    return samples.select("range", F.array_distinct(F.transform(F.expr("sequence(1, parts - 1)"), at)).alias("splitters"))


def ranges(units: DataFrame, wanted: int, seed: int = 11) -> DataFrame:
    """``units`` (of :func:`records`, stored) with ranges whose order is that of (key, doc_id).

    A range holds at most ``2 * wanted`` bytes or a single record and its copies.
    """
    spark = units.sparkSession
    ranged = units
    for level in range(_LEVELS):
        sizes = ranged.groupBy("range").agg(
            F.sum(F.col("size") * F.col("copies")).alias("range_bytes"),
            F.min(_place()).alias("low"),
            F.max(_place()).alias("high"),
        )
        # At most all bytes / (2 * wanted) rows, which MOST_RANGES bounds.
        full = settle(
            spark,
            sizes.where((F.col("range_bytes") > 2 * wanted) & ~F.col("low").eqNullSafe(F.col("high"))).select(
                "range",
                "range_bytes",
                F.least(F.lit(FAN_OUT), F.ceil(F.col("range_bytes") / wanted)).cast("int").alias("parts"),
            ),
            "overfull",
        )
        if full.isEmpty():
            break
        splitters = settle(spark, _sample(ranged, full, seed + level), "splitters")
        below = F.size(F.filter("splitters", lambda s: s < _place()))
        upto = F.size(F.filter("splitters", lambda s: s <= _place()))
        child = F.when(F.col("splitters").isNull(), 0).otherwise(below + upto)
        ranged = settle(
            spark,
            ranged.join(F.broadcast(splitters), "range", "left")
            .withColumn("range", F.shiftleft("range", _LEVEL_BITS) + child)
            .drop("splitters"),
            "ranged",
        )
    return ranged


def _boundaries(placed: DataFrame, total: int, n_shards: int, slack: float) -> list[int]:
    """Ends of all shards but the last, in bytes times ``n_shards``.

    An end inside a group of equal texts moves to the nearer edge of the group, where that lies within ``slack``
    times a shard; at most ``n_shards - 1`` groups are looked at.
    """
    ends = [s * total for s in range(1, n_shards)]
    if not ends:
        return []
    first, last = F.col("before") * n_shards, (F.col("before") + F.col("size") * F.col("copies")) * n_shards
    inside = F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: (first < e) & (e <= last))
    cut = {r["end"]: r["key"] for r in placed.select("key", F.explode(inside).alias("end")).collect()}
    groups = (
        placed.where(F.col("key").isin(sorted(set(cut.values()))))
        .groupBy("key")
        .agg(F.min(first).alias("low"), F.max(last).alias("high"))
    )
    edges = {r["key"]: (r["low"], r["high"]) for r in groups.collect()}
    moved = []
    for end in ends:
        low, high = edges[cut[end]]
        near = low if end - low <= high - end else high
        moved.append(near if abs(near - end) <= slack * total else end)
    return moved


def assign(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    range_bytes: int = RANGE_BYTES,
    slack: float = 0.01,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, size, text_crc32, shard, slot.

    ``size`` is the number of UTF-8 bytes of the text plus one; null counts as the empty text. Records
    lie in the order of (SHA-256 of the text, id), null ids first. A record belongs to the shard in
    which its middle byte lies, so shards differ by little more than a record; ``slot`` numbers the rows of a shard
    in that order from 0. Equal texts lie in one shard unless a shard's end falls into them and both edges are
    farther away than ``slack`` times a shard: a group that is too big for one shard is divided. Rows that repeat id
    and text are copies of one record and may be divided too. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    units = settle(spark, records(docs, id_col, text_col), "shard-records")
    total = units.agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")).first()["bytes"] or 0
    wanted = max(1, min(range_bytes, -(-total // (4 * n_shards))), total // MOST_RANGES)
    ranged = ranges(units, wanted)
    sums = ranged.groupBy("range").agg(
        F.sum(F.col("size") * F.col("copies")).alias("range_bytes"), F.sum("copies").alias("range_rows")
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(
        spark,
        sums.select(
            "range",
            F.coalesce(F.sum("range_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("range_rows").over(earlier), F.lit(0)).alias("rows_before"),
        ),
        "range-starts",
    )
    inside = Window.partitionBy("range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = settle(
        spark,
        ranged.join(by_ids(starts), "range").select(
            "range",
            "doc_id",
            "key",
            "size",
            "text_crc32",
            "copies",
            (F.col("bytes_before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))).alias("before"),
            (F.col("rows_before") + F.coalesce(F.sum("copies").over(inside), F.lit(0))).alias("row"),
        ),
        "placed",
    )
    ends = _boundaries(placed, total, n_shards, slack) if total else []
    strips = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_STRIP).cast("long")))
    copy = F.explode(F.sequence(F.col("strip"), F.least(F.col("strip") + _STRIP, F.col("copies")) - 1))
    rows = placed.withColumn("strip", strips).withColumn("copy", copy)
    middle = (2 * (F.col("before") + F.col("copy") * F.col("size")) + F.col("size")) * n_shards
    limits = F.array(*[F.lit(2 * end).cast("long") for end in ends]).cast("array<long>")
    sharded = rows.withColumn("shard", F.size(F.filter(limits, lambda end: end <= middle))).withColumn(
        "row", F.col("row") + F.col("copy")
    )
    firsts = {r["shard"]: r["first"] for r in sharded.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    first = F.array(*[F.lit(firsts.get(s, 0)).cast("long") for s in range(n_shards)])
    return sharded.select(
        "doc_id", "key", "size", "text_crc32", "shard", (F.col("row") - first[F.col("shard")]).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, text, slot) below ``path``, one folder per shard, rows of a file in slot order.

    Texts come from any row of a record, null as the empty text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    placed = assign(docs, n_shards, id_col, text_col).select("doc_id", "key", "shard", "slot")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("digest") == F.col("key"))
    one = texts.groupBy("id", "digest").agg(F.any_value("text").alias("text"))
    joined = placed.join(one, same).select("doc_id", "text", "shard", "slot")
    joined.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
