"""Market-shaped views of the test tables, for Spark and as SQL.

Amounts are whole cents, so sums are exact whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.functions.calendar import local_time, utc_floor
from wattline.operators.shaping import hour_spine
from wattline.operators.validation import seasonal_naive

ENERGY = {"wind_onshore_c": "click", "wind_offshore_c": "view", "solar_c": "purchase", "load_c": "error"}
COLUMNS = ("price_c", *ENERGY)
BOUNDS_C = {"price_c": (500.0, 20000.0), **{c: (100.0, 30000.0) for c in ENERGY}}
DAY_MICROS = 24 * 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("Z"), (F.col("user_id") % 4).cast("string")).alias("zone"),
        F.col("event_type").alias("series"),
        F.col("ts").alias("utc_timestamp"),
        F.round(F.col("value") * 100).cast("bigint").alias("value_c"),
        (F.col("event_id") % 3).alias("chunk_no"),
        "event_id",
    )


def _hourly(points: DataFrame, keys: list[str]) -> DataFrame:
    mean = F.floor(F.sum("value_c") / F.count(F.lit(1))).cast("double").alias("price_c")
    sums = [F.sum(F.when(F.col("series") == kind, F.col("value_c"))).cast("double").alias(c) for c, kind in ENERGY.items()]
    return points.groupBy(*keys, utc_floor("hour", "utc_timestamp").alias("utc_timestamp")).agg(mean, *sums)


def market_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(points_long(spark, sf_dir), ["zone"])


def market_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_long(spark, sf_dir).withColumn("zone", F.lit("ALL")).filter(F.col("utc_timestamp").isNotNull())
    hourly = _hourly(points, ["zone"])
    # The ends read all measures, so the events are aggregated once for both uses.
    ends = hourly.groupBy("zone").agg(
        F.min("utc_timestamp").alias("first"),
        F.max("utc_timestamp").alias("last"),
        F.count(F.coalesce(*COLUMNS)).alias("n"),
    )
    spine = hour_spine(ends.filter("n > 0"), ["zone"], "first", "last")
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ENERGY}
    return spine.join(hourly, ["zone", "utc_timestamp"], "left").withColumns(filled)


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("zone"), F.col("l_shipdate").cast("timestamp_ntz").alias("utc_timestamp"))
        .agg(
            F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count(F.lit(1)))
            .cast("double")
            .alias("y_c"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def forecast_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast_from(market_dense(spark, sf_dir))


def forecast_from(market: DataFrame) -> DataFrame:
    """Last week's price as forecast, with a band that widens with the local hour."""
    naive = seasonal_naive(market, target="price_c", name="y_pred")
    hour = F.hour(local_time("utc_timestamp"))
    half = F.lit(1000) + F.lit(10) * hour
    return naive.filter(F.col("y_pred").isNotNull()).select(
        "zone",
        "utc_timestamp",
        F.col("price_c").alias("y_true"),
        "y_pred",
        (F.col("y_pred") - half).alias("y_pred_p10"),
        (F.col("y_pred") + half).alias("y_pred_p90"),
    )


_POINTS = """points_long AS (
  SELECT concat('Z', cast(user_id % 4 AS varchar)) AS zone, event_type AS series, ts AS utc_timestamp,
         cast(round(value * 100) AS bigint) AS value_c, event_id % 3 AS chunk_no, event_id
  FROM events)"""

_MEASURES = """
         cast(floor(sum(value_c) / count(*)) AS double) AS price_c,
         cast(sum(CASE WHEN series = 'click' THEN value_c END) AS double) AS wind_onshore_c,
         cast(sum(CASE WHEN series = 'view' THEN value_c END) AS double) AS wind_offshore_c,
         cast(sum(CASE WHEN series = 'purchase' THEN value_c END) AS double) AS solar_c,
         cast(sum(CASE WHEN series = 'error' THEN value_c END) AS double) AS load_c"""

_SPARSE = f"""market_sparse AS (
  SELECT zone, date_trunc('hour', utc_timestamp) AS utc_timestamp,{_MEASURES}
  FROM points_long GROUP BY 1, 2)"""

_DENSE = f"""market_hours AS (
  SELECT date_trunc('hour', utc_timestamp) AS utc_timestamp,{_MEASURES}
  FROM points_long GROUP BY 1),
market_dense AS (
  SELECT 'ALL' AS zone, s.h AS utc_timestamp, m.price_c,
         coalesce(wind_onshore_c, 0) AS wind_onshore_c, coalesce(wind_offshore_c, 0) AS wind_offshore_c,
         coalesce(solar_c, 0) AS solar_c, coalesce(load_c, 0) AS load_c
  FROM (SELECT unnest(generate_series(min(utc_timestamp), max(utc_timestamp), interval 1 hour)) AS h
        FROM market_hours) s
  LEFT JOIN market_hours m ON m.utc_timestamp = s.h)"""

_LOCAL = "timezone('Europe/Berlin', timezone('UTC', {ts}))"

_FORECAST = f"""forecast_hourly AS (
  SELECT a.zone, a.utc_timestamp, a.price_c AS y_true, b.price_c AS y_pred,
         b.price_c - (1000 + 10 * hour({_LOCAL.format(ts="a.utc_timestamp")})) AS y_pred_p10,
         b.price_c + (1000 + 10 * hour({_LOCAL.format(ts="a.utc_timestamp")})) AS y_pred_p90
  FROM market_dense a JOIN market_dense b
    ON b.zone = a.zone AND b.utc_timestamp = a.utc_timestamp - interval 168 hour
  WHERE b.price_c IS NOT NULL)"""

_DAILY = """daily_series AS (
  SELECT l_returnflag AS zone, cast(l_shipdate AS timestamp) AS utc_timestamp,
         cast(floor(sum(cast(round(l_extendedprice * 100) AS bigint)) / count(*)) AS double) AS y_c,
         count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""

_NEEDS = {
    "points_long": [_POINTS],
    "market_sparse": [_POINTS, _SPARSE],
    "market_dense": [_POINTS, _DENSE],
    "forecast_hourly": [_POINTS, _DENSE, _FORECAST],
    "daily_series": [_DAILY],
}


def local_sql(ts: str) -> str:
    return _LOCAL.format(ts=ts)


def with_views(body: str, *views: str, steps: str = "") -> str:
    """SQL with the named fixture views (and further WITH ``steps``) in front."""
    parts: list[str] = []
    for view in views:
        parts += [p for p in _NEEDS[view] if p not in parts]
    if steps:
        parts.append(steps.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
