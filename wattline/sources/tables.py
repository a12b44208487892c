"""Stored tables and delivery files: parquet, CSV and JSON reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from wattline.config import TS, ZONE
from wattline.functions.numbers import nan_to_null

FORECAST_SCHEMA = "zone string, id timestamp, y_pred double, y_pred_p10 double, y_pred_p90 double"
VIEWS_SCHEMA = (
    "zone string, horizon string, period_label string, start timestamp_ntz, end timestamp_ntz, product_type string, "
    "forecast_mean_eur_mwh double, forecast_p10 double, forecast_p90 double, n_hours bigint"
)


def read_market(spark: SparkSession, path: str) -> DataFrame:
    """Stored market table; filters on zone, year and time reach the scan.

    The zone is text whatever it looks like (a folder name ``07`` would be read
    as a number), and missing measures are NULL, never NaN.
    """
    measures = [f for f in spark.read.parquet(path).schema.fields if f.name not in (ZONE, "year")]
    schema = StructType([*measures, StructField(ZONE, StringType()), StructField("year", IntegerType())])
    rows = spark.read.schema(schema).parquet(path).drop("year")
    return nan_to_null(rows.select(ZONE, *[f.name for f in measures]))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_market(df: DataFrame, path: str, *, ts: str = TS, zone: str = ZONE) -> None:
    """Parquet partitioned by zone and year.

    The rebalance hint lets AQE merge small output partitions and split a zone
    that holds much of the data.
    """
    dated = df.withColumn("year", F.year(ts))
    dated.hint("rebalance", zone, "year").sortWithinPartitions(zone, "year", ts).write.mode("overwrite").partitionBy(
        zone, "year"
    ).parquet(path)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], *, force: bool = False
) -> DataFrame:
    """The stored market table, or the built one after storing it; a half-written table is built anew."""
    if not force and is_complete(spark, path):
        return read_market(spark, path)
    write_market(build(), path)
    return read_market(spark, path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Forecast file with its ISO id as zone-less UTC time."""
    rows = read_csv(spark, path, FORECAST_SCHEMA)
    return rows.select(ZONE, F.col("id").cast("timestamp_ntz").alias(TS), "y_pred", "y_pred_p10", "y_pred_p90")


def report_json(parts: dict[str, DataFrame], keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """One JSON document per zone from small per-zone tables.

    Each part becomes an array of objects under its name. The tables hold
    checks and summaries, a few rows per zone.
    """
    sections = []
    for name, part in parts.items():
        body = F.struct(*[c for c in part.columns if c not in keys])
        sections.append(
            part.select(*keys, F.lit(name).alias("_name"), F.to_json(body, {"ignoreNullFields": "false"}).alias("_body"))
        )
    union = sections[0]
    for section in sections[1:]:
        union = union.unionByName(section)
    arrays = [
        F.concat(
            F.lit(f'"{name}":['),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("_name") == name, F.col("_body")))), ","),
            F.lit("]"),
        )
        for name in parts
    ]
    document = F.concat(F.lit("{"), F.concat_ws(",", *arrays), F.lit("}"))
    return union.groupBy(*keys).agg(document.alias("report"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str, *, zone: str = ZONE) -> None:
    """One folder per zone with its report document as text."""
    report.write.mode("overwrite").partitionBy(zone).text(path)
