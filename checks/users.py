"""The main operators over a market table that grows with the test tables: a zone for every user, on the hourly grid.

Hours without events get values that follow from zone and hour, so every zone has a whole month of hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.delivery import _euro, _views_sql
from checks.features import _MATRIX, SPEC, _filled, _matrix_sql, _shown
from checks.fixtures import COLUMNS, ENERGY, _hourly, forecast_from, local_sql, points_long, with_views
from checks.quality import _union
from checks.registry import query
from wattline.operators import delivery, features, rules, validation
from wattline.operators.rules import Rule
from wattline.operators.shaping import missing_hours
from wattline.plans import clustered
from wattline.session import settle

#: What an hour without events has, in cents, by zone number and hour of the month.
_BASE = {c: (500 + 700 * i, 37 + i, 101 + 10 * i, 4000 - 700 * i) for i, c in enumerate(COLUMNS)}


def market_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_long(spark, sf_dir).drop("zone").join(
        spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id"), "event_id"
    )
    # Read four times below.
    hourly = settle(spark, _hourly(points.filter("user_id is not null and utc_timestamp is not null"), ["user_id"]), "user-hours")
    hours = hourly.agg(F.min("utc_timestamp").alias("first"), F.max("utc_timestamp").alias("last"))
    # One row of two hours, so this is no cross join of tables.
    first, last = hours.first()
    users = hourly.select("user_id").distinct().withColumns({"first": F.lit(first), "last": F.lit(last)})
    rows = hourly.unionByName(missing_hours(users, hourly, ["user_id"], "first", "last"), allowMissingColumns=True)
    hour = F.unix_seconds(F.col("utc_timestamp").cast("timestamp")) / 3600
    filled = {}
    for c, (least, by_zone, by_hour, spread) in _BASE.items():
        made = least + F.pmod(F.col("user_id") * by_zone + F.floor(hour) * by_hour, F.lit(spread))
        filled[c] = F.coalesce(F.col(c), made.cast("double"))
    rows = rows.withColumns(filled).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("zone"), "utc_timestamp", *COLUMNS)
    return settle(spark, rows, "market-users")


_SUMS = ", ".join(f"cast(sum(CASE WHEN event_type = '{kind}' THEN cast(round(value * 100) AS bigint) END) AS double) AS {c}" for c, kind in ENERGY.items())
_MADE = ", ".join(
    f"coalesce({c}, {least} + (user_id * {by_zone} + epoch(h)::bigint // 3600 * {by_hour}) % {spread})::double AS {c}"
    for c, (least, by_zone, by_hour, spread) in _BASE.items()
)
_USERS = f"""user_hours AS (
  SELECT user_id, date_trunc('hour', ts) AS h,
    cast(floor(sum(cast(round(value * 100) AS bigint)) / count(*)) AS double) AS price_c, {_SUMS} FROM events GROUP BY 1, 2),
spine AS (SELECT user_id, unnest(generate_series(a, b, interval 1 hour)) AS h
  FROM (SELECT DISTINCT user_id FROM user_hours), (SELECT min(h) AS a, max(h) AS b FROM user_hours)),
market_users AS MATERIALIZED (SELECT concat('U', user_id) AS zone, h AS utc_timestamp, {_MADE}
  FROM spine LEFT JOIN user_hours USING (user_id, h))"""


@query("feature_matrix_users", with_views(_matrix_sql("filled"), steps=f"{_USERS},\n{_filled('market_users', -50000, 300000)}"))
def feature_matrix_users(spark, sf_dir):
    return _shown(features.feature_matrix(market_users(spark, sf_dir), SPEC, lag_mode="time"), ["price_c", *_MATRIX])


_NAIVE = """naive AS (SELECT a.zone, a.utc_timestamp, a.price_c, b.price_c AS y_naive FROM market_users a
  LEFT JOIN market_users b ON b.zone = a.zone AND b.utc_timestamp = a.utc_timestamp - interval 168 hour)"""


@query("seasonal_naive_users", with_views("SELECT * FROM naive", steps=f"{_USERS},\n{_NAIVE}"))
def seasonal_naive_users(spark, sf_dir):
    return validation.seasonal_naive(market_users(spark, sf_dir).select("zone", "utc_timestamp", "price_c"), target="price_c")


_LOCAL_HOUR = f"hour({local_sql('utc_timestamp')})"
_FORECAST = f"""forecast_users AS (
  SELECT zone, utc_timestamp, price_c AS y_true, y_naive AS y_pred, y_naive - (1000 + 10 * {_LOCAL_HOUR}) AS y_pred_p10,
    y_naive + (1000 + 10 * {_LOCAL_HOUR}) AS y_pred_p90 FROM naive WHERE y_naive IS NOT NULL)"""


@query("delivery_views_users", with_views(
    f"{_views_sql('week', source='forecast_users')} UNION ALL {_views_sql('month', source='forecast_users')}",
    steps=f"{_USERS},\n{_NAIVE},\n{_FORECAST}"))
def delivery_views_users(spark, sf_dir):
    return _euro(delivery.all_views(forecast_from(market_users(spark, sf_dir))))


_ORDER = "(PARTITION BY zone ORDER BY utc_timestamp"
_RULES = (
    (Rule("price_jump", "price_c", "s.diff().abs() <= 3500"),
     f"abs(price_c - lag(price_c) OVER {_ORDER})) <= 3500"),
    (Rule("load_median", "load_c", "(s - s.rolling(48).median()).abs() <= 2500"),
     f"abs(load_c - CASE WHEN count(*) OVER {_ORDER} ROWS 47 PRECEDING) = 48 THEN quantile_cont(load_c, 0.5) OVER {_ORDER} ROWS 47 PRECEDING) END) <= 2500"),
    (Rule("solar_upto_mean", "solar_c", "s <= 2 * s.expanding().mean()"), f"solar_c <= 2 * avg(solar_c) OVER {_ORDER} ROWS UNBOUNDED PRECEDING)"),
    (Rule("price_rank", "price_c", "s.rank(pct=True) <= 0.99"),
     "(rank() OVER (PARTITION BY zone ORDER BY price_c) + (count(*) OVER (PARTITION BY zone, price_c) - 1) / 2.0) / count(*) OVER (PARTITION BY zone) <= 0.99"),
    (Rule("onshore_spread", "wind_onshore_c", "(s - s.mean()).abs() <= 3 * s.std()"),
     "abs(wind_onshore_c - avg(wind_onshore_c) OVER (PARTITION BY zone)) <= 3 * stddev_samp(wind_onshore_c) OVER (PARTITION BY zone)"),
)
_RULES_SQL = _union([
    f"""SELECT zone, '{r.name}' AS name, count(*) FILTER (NOT coalesce(ok, false)) AS violations
    FROM (SELECT zone, {ok} AS ok FROM market_users) GROUP BY 1""" for r, ok in _RULES])


@query("rule_results_users", with_views(_RULES_SQL, steps=_USERS))
def rule_results_users(spark, sf_dir):
    results = rules.run_rules(market_users(spark, sf_dir), [r for r, _ in _RULES])
    return results.select("zone", "name", "violations")


@query("feature_matrix_clustered", with_views(_matrix_sql("filled"), steps=f"{_USERS},\n{_filled('market_users', -50000, 300000)}"))
def feature_matrix_clustered(spark, sf_dir):
    """The feature matrix from a table that is stored in blocks by zone and time, without an exchange."""
    name = clustered.store(market_users(spark, sf_dir), look_back=SPEC.look_back(), buckets=16)
    return _shown(features.matrix_of(clustered.load(spark, name), SPEC), ["price_c", *_MATRIX])
