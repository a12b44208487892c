"""Market table that is brought up to date from the landed files that changed.

A ledger holds path, length and time of every file that went in, and the months in which it has points. A run lists
the landed files, reads those that are new or changed, and rebuilds the months that these, or the former
content of changed and vanished files, have points in; other months keep their folders. Everything is written
into folders of the run's own. The last write is a manifest that names the folders of all months: it appears as one
file at once, readers follow the newest manifest, and a run that dies before it leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.config import DOCUMENT_TYPES, SERIES_IDS, TS, ZONE
from wattline.functions.calendar import utc_floor
from wattline.operators.shaping import SERIES, align_wide, hourly_values, on_grid, time_slice, union_keep_first
from wattline.plans.sizes import small_side
from wattline.sources import landing_json, landing_xml

_MONTH = "month"
_POINTS = f"{ZONE} string, {SERIES} string, {TS} timestamp_ntz, value double, chunk string, file_path string"
_HOURS = f"{ZONE} string, {SERIES} string, {TS} timestamp_ntz, value double"
_SPANS = f"{_MONTH} string, {ZONE} string, {SERIES} string, first timestamp_ntz, last timestamp_ntz"
_LEDGER = "file_path string, length bigint, modified timestamp, months array<string>"


@dataclass(frozen=True)
class Feed:
    """Landed files of one kind: how points are read from some of them, and how points become hours."""

    path: str
    scan: Callable[[SparkSession, Sequence[str]], DataFrame]
    hours: Callable[[DataFrame], DataFrame]
    how: str
    series: tuple[str, ...]


def json_feed(path: str, start_date: str, end_date: str, *, partitioned: bool = False, ids: Mapping[str, int] = SERIES_IDS) -> Feed:
    """As ``landing_json.market_table`` reads them."""

    def scan(spark: SparkSession, only: Sequence[str]) -> DataFrame:
        points = landing_json.scan_chunks(spark, path, start_date, end_date, partitioned=partitioned, ids=ids, only=only, with_file=True)
        return points.withColumn("chunk", F.col("chunk_ms").cast("string"))

    return Feed(path, scan, lambda points: hourly_values(points, how="rule"), "rule", tuple(ids))


def xml_feed(path: str, start_date: str, end_date: str, *, types: Mapping[tuple[str, str], str] = DOCUMENT_TYPES) -> Feed:
    """As ``landing_xml.market_table`` reads them: of repeated hours the first document's stays."""

    def scan(spark: SparkSession, only: Sequence[str]) -> DataFrame:
        points = landing_xml.scan_documents(spark, path, types=types, only=only, with_file=True)
        return time_slice(points, f"{start_date} 00:00:00", f"{end_date} 23:59:59.999999").withColumnRenamed("chunk_no", "chunk")

    def hours(points: DataFrame) -> DataFrame:
        hourly = points.groupBy(ZONE, SERIES, utc_floor("hour", TS).alias(TS), "chunk").agg(F.avg("value").alias("value"))
        return union_keep_first([hourly], order=("chunk",))

    return Feed(path, scan, hours, "mean", tuple(dict.fromkeys(types.values())))


def current(spark: SparkSession, root: str) -> dict | None:
    """The newest manifest below ``root``: version, ledger and spans folders, and a folder per month of points, hours and market."""
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(f"{root}/manifests").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = []
    return max((json.loads(line["value"]) for line in lines), key=lambda m: m["version"], default=None)


def market(spark: SparkSession, root: str) -> DataFrame:
    """The hourly wide table that the newest manifest names."""
    manifest = current(spark, root)
    if manifest is None:
        raise ValueError(f"nothing has been ingested into {root}")
    schema = f"{ZONE} string, {TS} timestamp_ntz, " + ", ".join(f"`{c}` double" for c in manifest["series"])
    return _read(spark, manifest["market"].values(), schema)


def _read(spark: SparkSession, folders, schema: str) -> DataFrame:
    folders = sorted(folders)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """path, file_path, length and modified of every landed file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.col("_metadata.file_path").alias("file_path"), "length", F.col("modificationTime").alias("modified")
    )


def _months_between(first: str, last: str):
    return F.transform(
        F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), lambda m: F.date_format(m, "yyyy-MM")
    )


def ingest(spark: SparkSession, feed: Feed, root: str) -> dict:
    """Bring the table below ``root`` up to date with the landed files, and return the manifest that is then current.

    The result equals a build from all files that are landed now. One writer at a time; readers are not disturbed.
    Only the names of files and months, which the listing and the calendar bound, reach the driver.
    """
    before = current(spark, root)
    folder = f"{root}/data/{uuid.uuid4().hex}"
    listed = _listed(spark, feed.path)
    known = _read(spark, [before["ledger"]] if before else [], _LEDGER)
    same = ["file_path", "length", "modified"]
    fresh = [r["path"] for r in listed.join(known, same, "left_anti").select("path").collect()]
    stale = known.join(listed, same, "left_anti")
    if before and not fresh and stale.isEmpty():
        return before

    # Points of the new and changed files, stored by month.
    if fresh:
        points = feed.scan(spark, fresh).select(ZONE, SERIES, TS, "value", "chunk", "file_path")
        points = points.filter(F.col(ZONE).isNotNull() & F.col(TS).isNotNull())
    else:
        points = spark.createDataFrame([], _POINTS)
    month = F.date_format(TS, "yyyy-MM")
    points.withColumn(_MONTH, month).hint("rebalance", _MONTH).write.partitionBy(_MONTH).parquet(f"{folder}/fresh")
    found = spark.read.schema(f"{_POINTS}, {_MONTH} string").parquet(f"{folder}/fresh")
    by_file = found.groupBy("file_path").agg(F.array_sort(F.collect_set(_MONTH)).alias("months"))
    named = listed.join(known.select(*same), same, "left_anti").join(by_file, "file_path", "left")
    ledger = known.join(stale.select(*same), same, "left_anti").unionByName(
        named.select(*same, F.coalesce("months", F.array().cast("array<string>")).alias("months"))
    )
    ledger.coalesce(8).write.parquet(f"{folder}/ledger")

    touched = {r[_MONTH] for r in found.select(_MONTH).distinct().collect()}
    touched |= {r[_MONTH] for r in stale.select(F.explode("months").alias(_MONTH)).distinct().collect()}
    manifest = {
        "version": before["version"] + 1 if before else 1,
        "ledger": f"{folder}/ledger",
        "series": list(feed.series),
        **{part: dict(before[part]) if before else {} for part in ("points", "hours", "market")},
    }
    kept = _read(spark, [manifest["points"][m] for m in touched if m in manifest["points"]], _POINTS)
    kept = kept.join(small_side(stale.select("file_path")), "file_path", "left_anti")
    merged = kept.select(*found.drop(_MONTH).columns).unionByName(found.drop(_MONTH)).withColumn(_MONTH, month)
    _store(merged, f"{folder}/points", manifest["points"], touched)

    points = _read(spark, [manifest["points"][m] for m in touched if m in manifest["points"]], _POINTS)
    _store(feed.hours(points).withColumn(_MONTH, month), f"{folder}/hours", manifest["hours"], touched)

    # First and last hour of every series, by month.
    hours = _read(spark, [manifest["hours"][m] for m in touched if m in manifest["hours"]], _HOURS)
    old_spans = _read(spark, [before["spans"]] if before else [], _SPANS)
    new_spans = hours.filter("value is not null").groupBy(month.alias(_MONTH), ZONE, SERIES).agg(F.min(TS).alias("first"), F.max(TS).alias("last"))
    untouched = old_spans.filter(~F.col(_MONTH).isin(sorted(touched))) if touched else old_spans
    manifest["spans"] = f"{folder}/spans"
    untouched.unionByName(new_spans.select(*old_spans.columns)).coalesce(8).write.parquet(manifest["spans"])

    # Where a series begins or ends elsewhere than before, the grid between changes too.
    ends = [
        spans.groupBy(ZONE, SERIES).agg(F.min("first").alias(f"{side}_first"), F.max("last").alias(f"{side}_last"))
        for side, spans in (("old", old_spans), ("new", spark.read.schema(_SPANS).parquet(manifest["spans"])))
    ]
    moved = ends[0].join(ends[1], [ZONE, SERIES], "full").select(
        F.least("old_first", "new_first").alias("a"),
        F.greatest("old_first", "new_first").alias("b"),
        F.least("old_last", "new_last").alias("c"),
        F.greatest("old_last", "new_last").alias("d"),
        F.expr("old_first is null or new_first is null").alias("whole"),
    )
    stretches = F.when(F.col("whole"), _months_between("a", "d")).otherwise(
        F.concat(
            F.when(F.col("a") < F.col("b"), _months_between("a", "b")).otherwise(F.array().cast("array<string>")),
            F.when(F.col("c") < F.col("d"), _months_between("c", "d")).otherwise(F.array().cast("array<string>")),
        )
    )
    laid = touched | {r[_MONTH] for r in moved.select(F.explode(stretches).alias(_MONTH)).distinct().collect()}
    bounds = ends[1].select(ZONE, SERIES, F.explode(_months_between("new_first", "new_last")).alias(_MONTH), "new_first", "new_last")
    start = F.to_date(F.concat(_MONTH, F.lit("-01"))).cast("timestamp_ntz")
    clipped = bounds.filter(F.col(_MONTH).isin(sorted(laid))).select(
        ZONE,
        SERIES,
        F.greatest("new_first", start).alias("_first"),
        F.least("new_last", F.add_months(start.cast("date"), 1).cast("timestamp_ntz") - F.expr("interval 1 hour")).alias("_last"),
    )
    hours = _read(spark, [manifest["hours"][m] for m in laid if m in manifest["hours"]], _HOURS)
    wide = align_wide(on_grid(hours, clipped, how=feed.how), list(feed.series))
    _store(wide.withColumn(_MONTH, month), f"{folder}/market", manifest["market"], laid)
    publish(spark, root, manifest)
    return manifest


def _store(rows: DataFrame, folder: str, folders: dict[str, str], months: set[str]) -> None:
    """Write ``rows`` by month and note the folder of each of ``months`` that has rows."""
    rows.hint("rebalance", _MONTH).sortWithinPartitions(_MONTH, ZONE, TS).write.partitionBy(_MONTH).parquet(folder)
    written = {r[_MONTH] for r in rows.sparkSession.read.schema(f"{ZONE} string, {_MONTH} string").parquet(folder).select(_MONTH).distinct().collect()}
    for name in months:
        folders.pop(name, None)
        if name in written:
            folders[name] = f"{folder}/{_MONTH}={name}"


def publish(spark: SparkSession, root: str, manifest: dict) -> None:
    """The switch: one file with one line, which its commit puts in place at once."""
    line = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1)
    line.write.text(f"{root}/manifests/v{manifest['version']:09d}")
