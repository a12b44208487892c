"""Landed JSON chunks: ``{"series": [[epoch_ms, value], …]}``, one chunk a file.

Two layouts are read. Partition folders ``series_id=…/chunk_ms=…`` let Spark
skip folders outside the wanted period. Flat files named
``{series_id}_{region}_quarterhour_{chunk_ms}.json`` carry the same two values
in the file name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.config import SERIES_IDS, TS, ZONE
from wattline.operators.shaping import align_wide, resample_hourly

PAYLOAD = "series array<array<double>>"
WEEK_MS = 7 * 24 * 3600 * 1000
_FILE_NAME = r"^(\d+)_(.+)_[^_]+_(\d+)\.json$"


def window_millis(start_date: str, end_date: str) -> tuple[int, int]:
    """Start of the first day and 23:59 of the last day, in UTC."""
    start = datetime.fromisoformat(start_date).replace(tzinfo=timezone.utc)
    end = datetime.fromisoformat(end_date).replace(hour=23, minute=59, tzinfo=timezone.utc)
    return int(start.timestamp() * 1000), int(end.timestamp() * 1000)


def series_registry(spark: SparkSession, ids: Mapping[str, int] = SERIES_IDS) -> DataFrame:
    """Series name and numeric id; its size is the number of known series."""
    return F.broadcast(spark.createDataFrame([(i, c) for c, i in ids.items()], "series_id bigint, series string"))


def _files(spark: SparkSession, path: str, partitioned: bool, only: Sequence[str] | None = None) -> DataFrame:
    """One row per file: what its place says about it, its payload, and whether it is readable.

    Files are read whole, so line breaks inside a payload do not matter. ``only`` names the files below ``path`` that are read.
    """
    schema = "value string" + (", series_id bigint, zone string, chunk_ms bigint" if partitioned else "")
    raw = spark.read.schema(schema).option("basePath", path).text(path if only is None else list(only), wholetext=True)
    name = F.col("_metadata.file_name")
    place = (
        [F.col("series_id"), F.col(ZONE), F.col("chunk_ms")]
        if partitioned
        else [
            F.try_to_number(F.regexp_extract(name, _FILE_NAME, 1), F.lit("9" * 18)).cast("bigint").alias("series_id"),
            F.regexp_extract(name, _FILE_NAME, 2).alias(ZONE),
            F.try_to_number(F.regexp_extract(name, _FILE_NAME, 3), F.lit("9" * 18)).cast("bigint").alias("chunk_ms"),
        ]
    )
    read = raw.select(
        *place,
        name.alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.from_json("value", f"{PAYLOAD}, _corrupt_record string").alias("_read"),
        F.regexp_count("value", F.lit(r'"series"\s*:')).alias("_payloads"),
    )
    whole = F.col("_read._corrupt_record").isNull() & F.col("_read.series").isNotNull() & (F.col("_payloads") == 1)
    return read.select(
        "series_id", ZONE, "chunk_ms", "file_name", "file_path", F.col("_read.series").alias("series"),
        F.coalesce(whole, F.lit(False)).alias("readable"),
    )


def read_chunks(
    spark: SparkSession, path: str, *, partitioned: bool = False, only: Sequence[str] | None = None
) -> DataFrame:
    """One row per readable chunk: series_id, zone, chunk_ms, file_path and the payload array."""
    return _files(spark, path, partitioned, only).filter("readable").select("series_id", ZONE, "chunk_ms", "file_path", "series")


def scan_rejects(
    spark: SparkSession, path: str, *, partitioned: bool = False, ids: Mapping[str, int] = SERIES_IDS
) -> DataFrame:
    """Files that give no points: file_name, series_id, zone, reason."""
    files = _files(spark, path, partitioned).join(
        series_registry(spark, ids).withColumnRenamed("series", "_known"), "series_id", "left"
    )
    reason = F.when(F.col("series_id").isNull() | F.col("chunk_ms").isNull(), "file name not understood").when(
        F.col("_known").isNull(), "unknown series"
    ).when(~F.col("readable"), "payload not readable")
    return files.select("file_name", "series_id", ZONE, reason.alias("reason")).filter(F.col("reason").isNotNull())


def scan_chunks(
    spark: SparkSession,
    path: str,
    start_date: str,
    end_date: str,
    *,
    partitioned: bool = False,
    ids: Mapping[str, int] = SERIES_IDS,
    only: Sequence[str] | None = None,
    with_file: bool = False,
) -> DataFrame:
    """Points in long form: zone, series, utc_timestamp, value, chunk_ms, and file_path if asked for.

    Chunks that start more than a week before the window, or after it, are
    skipped. Points outside the window (ends included), null values and incomplete
    pairs go.
    """
    start_ms, end_ms = window_millis(start_date, end_date)
    chunks = (
        read_chunks(spark, path, partitioned=partitioned, only=only)
        .filter(F.col("chunk_ms").between(start_ms - WEEK_MS, end_ms))
        .withColumnRenamed("series", "_points")
    )
    points = chunks.select("series_id", ZONE, "chunk_ms", "file_path", F.explode("_points").alias("_p")).select(
        "series_id",
        ZONE,
        "chunk_ms",
        "file_path",
        F.get("_p", 0).cast("bigint").alias("_ms"),
        F.nanvl(F.get("_p", 1), F.lit(None).cast("double")).alias("value"),
    )
    kept = points.filter(F.col("_ms").between(start_ms, end_ms) & F.col("value").isNotNull())
    return kept.join(series_registry(spark, ids), "series_id").select(
        ZONE, "series", F.timestamp_millis("_ms").cast("timestamp_ntz").alias(TS), "value", "chunk_ms", *(["file_path"] if with_file else [])
    )


def market_table(spark: SparkSession, path: str, start_date: str, end_date: str, **options) -> DataFrame:
    """Hourly wide table of all landed series in the window."""
    points = scan_chunks(spark, path, start_date, end_date, **options)
    return align_wide(resample_hourly(points, how="rule"), list(options.get("ids", SERIES_IDS)))
