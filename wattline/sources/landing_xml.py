"""Landed XML market documents: ``TimeSeries / Period / Point``.

Documents lie in partition folders ``doc_type=…/psr_type=…/zone=…`` (``psr_type=-``
for prices and load), which name the series and let unwanted kinds be skipped.
``TimeSeries`` is the row tag, so one huge document splits into many rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.config import DOCUMENT_TYPES, TS, ZONE
from wattline.functions.calendar import utc_floor
from wattline.operators.shaping import align_wide, resample_hourly, time_slice, union_keep_first

TIME_SERIES = (
    "Period array<struct<timeInterval:struct<start:string,end:string>,resolution:string,"
    "Point:array<struct<position:int,`price.amount`:double,quantity:double>>>>, "
    "doc_type string, psr_type string, zone string"
)
REASON = "code string, text string, doc_type string, psr_type string, zone string"

START_FORMAT = "yyyy-MM-dd'T'HH:mm[:ss]XXX"

# Minutes per resolution code; other codes mean one hour.
RESOLUTION_MINUTES = {"PT60M": 60, "PT30M": 30, "PT15M": 15}


def document_registry(spark: SparkSession, types: Mapping[tuple[str, str], str] = DOCUMENT_TYPES) -> DataFrame:
    """Document kind to series name; its size is the number of known kinds."""
    rows = [(doc, psr, series) for (doc, psr), series in types.items()]
    return F.broadcast(spark.createDataFrame(rows, "doc_type string, psr_type string, series string"))


def _step_minutes(resolution: str) -> Column:
    minutes = F.lit(60)
    for code, value in RESOLUTION_MINUTES.items():
        minutes = F.when(F.col(resolution) == code, value).otherwise(minutes)
    return minutes


def _read(spark: SparkSession, path: str, row_tag: str, schema: str, only: Sequence[str] | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("rowTag", row_tag).option("ignoreNamespace", True)
    return reader.option("basePath", path).format("xml").load(path if only is None else list(only))


def scan_documents(
    spark: SparkSession,
    path: str,
    *,
    first_period_only: bool = False,
    types: Mapping[tuple[str, str], str] = DOCUMENT_TYPES,
    only: Sequence[str] | None = None,
    with_file: bool = False,
) -> DataFrame:
    """Points in long form: zone, series, utc_timestamp, value, chunk_no, and file_path if asked for.

    A point lies (position − 1) steps after its period's start; a missing
    position means the first. The value is the price, else the quantity; points
    with neither go. ``chunk_no`` numbers documents by file name for
    keep-first deduplication. ``only`` names the files below ``path`` that are read.
    """
    series = _read(spark, path, "TimeSeries", TIME_SERIES, only)
    periods = F.slice("Period", 1, 1) if first_period_only else F.col("Period")
    flat = series.select(
        "doc_type", "psr_type", ZONE, F.col("_metadata.file_name").alias("chunk_no"),
        F.col("_metadata.file_path").alias("file_path"), F.explode(periods).alias("_p")
    ).select(
        "doc_type",
        "psr_type",
        ZONE,
        "chunk_no",
        "file_path",
        F.try_to_timestamp(F.col("_p.timeInterval.start"), F.lit(START_FORMAT)).cast("timestamp_ntz").alias("_start"),
        F.col("_p.resolution").alias("_resolution"),
        F.explode("_p.Point").alias("_point"),
    )
    usable = flat.filter(F.col("_start").isNotNull() & F.col("_resolution").isNotNull())
    steps = F.coalesce(F.col("_point.position"), F.lit(1)) - 1
    value = F.coalesce(F.col("_point").getField("price.amount"), F.col("_point.quantity"))
    at = F.col("_start") + F.make_dt_interval(mins=steps * _step_minutes("_resolution"))
    return (
        usable.join(document_registry(spark, types), ["doc_type", "psr_type"])
        .select(ZONE, "series", at.alias(TS), value.alias("value"), "chunk_no", *(["file_path"] if with_file else []))
        .filter(F.col("value").isNotNull())
    )


def scan_rejections(spark: SparkSession, path: str) -> DataFrame:
    """Documents that carry a rejection instead of data, with its text."""
    reasons = _read(spark, path, "Reason", REASON)
    return reasons.filter(F.col("text").isNotNull()).select(
        "doc_type", "psr_type", ZONE, F.col("_metadata.file_name").alias("file_name"), "code", "text"
    )


def scan_rejects(
    spark: SparkSession, path: str, *, types: Mapping[tuple[str, str], str] = DOCUMENT_TYPES
) -> DataFrame:
    """Documents that give no points: file_name, doc_type, psr_type, zone, reason.

    A rejection's own text is the reason where there is one.
    """
    place = ["doc_type", "psr_type", ZONE]
    schema = "value string, doc_type string, psr_type string, zone string"
    files = (
        spark.read.schema(schema).option("basePath", path).text(path, wholetext=True)
        .select(*place, F.col("_metadata.file_name").alias("file_name"))
    )
    series = _read(spark, path, "TimeSeries", TIME_SERIES).filter(F.size("Period") > 0)
    told = series.select(*place, F.col("_metadata.file_name").alias("file_name")).distinct().withColumn("_told", F.lit(True))
    rejected = scan_rejections(spark, path).groupBy(*place, "file_name").agg(F.min("text").alias("_text"))
    known = document_registry(spark, types).withColumnRenamed("series", "_series")
    found = (
        files.join(told, [*place, "file_name"], "left")
        .join(rejected, [*place, "file_name"], "left")
        .join(known, ["doc_type", "psr_type"], "left")
    )
    reason = (
        F.when(F.col("_text").isNotNull(), F.col("_text"))
        .when(F.col("_told").isNull(), "no readable series in the document")
        .when(F.col("_series").isNull(), "unknown document kind")
    )
    return found.select("file_name", *place, reason.alias("reason")).filter(F.col("reason").isNotNull())


def market_table(spark: SparkSession, path: str, start_date: str, end_date: str, **options) -> DataFrame:
    """Hourly wide table of all landed series from the first to the last day.

    Every series is averaged over the hour; repeated hours of overlapping
    documents keep the first document that has a value. The dense hourly grid is
    laid once per series, after that, so documents may interleave. Points outside
    the window are left out before they are shuffled.
    """
    points = time_slice(scan_documents(spark, path, **options), f"{start_date} 00:00:00", f"{end_date} 23:59:59.999999")
    hourly = points.groupBy(ZONE, "series", utc_floor("hour", TS).alias(TS), "chunk_no").agg(F.avg("value").alias("value"))
    unique = union_keep_first([hourly])
    return align_wide(
        resample_hourly(unique, how="mean", keys=(ZONE, "series")),
        list(dict.fromkeys(options.get("types", DOCUMENT_TYPES).values())),
    )
