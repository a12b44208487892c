from pyspark.sql import functions as F

from checks.fixtures import (
    COLUMNS, local_sql, market_dense, market_sparse, points_long, table, with_views,
)
from checks.registry import query
from wattline.functions.numbers import row_sum
from wattline.operators import shaping


def _cents(df, **columns):
    return df.withColumns({new: F.col(old) / 100.0 for new, old in columns.items()}).drop(*columns.values())


_GRID = """
hourly AS (
  SELECT zone, series, date_trunc('hour', utc_timestamp) AS h, sum(value_c) AS s, count(*) AS n
  FROM points_long GROUP BY 1, 2, 3),
grid AS (
  SELECT zone, series, unnest(generate_series(min(h), max(h), interval 1 hour)) AS h FROM hourly GROUP BY 1, 2)"""


@query("resample_hourly_mean", with_views(
    """SELECT g.zone, g.series, g.h AS utc_timestamp, round(cast(s AS double) / n / 100.0, 6) AS value
    FROM grid g LEFT JOIN hourly x ON g.zone = x.zone AND g.series = x.series AND g.h = x.h""",
    "points_long", steps=_GRID))
def resample_hourly_mean(spark, sf_dir):
    hourly = shaping.resample_hourly(points_long(spark, sf_dir), how="mean", value="value_c")
    return hourly.select("zone", "series", "utc_timestamp", F.round(F.col("value_c") / 100.0, 6).alias("value"))


@query("resample_hourly_sum", with_views(
    """SELECT g.zone, g.series, g.h AS utc_timestamp, cast(coalesce(s, 0) AS double) / 100.0 AS value
    FROM grid g LEFT JOIN hourly x ON g.zone = x.zone AND g.series = x.series AND g.h = x.h""",
    "points_long", steps=_GRID))
def resample_hourly_sum(spark, sf_dir):
    hourly = shaping.resample_hourly(points_long(spark, sf_dir), how="sum", value="value_c")
    return _cents(hourly, value="value_c")


@query("union_dedupe_first", with_views(
    """SELECT zone, series, h AS utc_timestamp, value_c FROM (
      SELECT zone, series, date_trunc('hour', utc_timestamp) AS h, value_c,
             row_number() OVER (PARTITION BY zone, series, date_trunc('hour', utc_timestamp)
                                ORDER BY chunk_no, event_id) AS rn
      FROM points_long) WHERE rn = 1""", "points_long"))
def union_dedupe_first(spark, sf_dir):
    points = points_long(spark, sf_dir).withColumn(
        "utc_timestamp", F.date_trunc("hour", "utc_timestamp").cast("timestamp_ntz"))
    chunks = [points.filter(F.col("chunk_no") == k) for k in range(3)]
    return shaping.union_keep_first(chunks, value="value_c", order=("chunk_no", "event_id"))


@query("year_chunks", """
WITH ranges AS (
  SELECT l_returnflag AS zone, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1),
years AS (
  SELECT zone, s, e, unnest(generate_series(date_trunc('year', s), e, interval 1 year)) AS y FROM ranges)
SELECT zone, year(y) AS year, greatest(s, cast(y AS timestamp)) AS chunk_start,
       least(e, cast(y AS timestamp) + interval 1 year) AS chunk_end,
       e < cast(y AS timestamp) + interval 1 year AS end_inclusive
FROM years""")
def year_chunks(spark, sf_dir):
    ranges = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("zone"))
        .agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    )
    return shaping.year_chunks(ranges, "s", "e")


@query("align_wide", with_views(
    """SELECT zone, h AS utc_timestamp,
      max(CASE WHEN series = 'click' THEN v END) AS click, max(CASE WHEN series = 'error' THEN v END) AS error,
      max(CASE WHEN series = 'purchase' THEN v END) AS purchase, max(CASE WHEN series = 'signup' THEN v END) AS signup,
      max(CASE WHEN series = 'view' THEN v END) AS view
    FROM (SELECT zone, series, date_trunc('hour', utc_timestamp) AS h, cast(sum(value_c) AS double) / 100.0 AS v
          FROM points_long GROUP BY 1, 2, 3) GROUP BY 1, 2""", "points_long"))
def align_wide(spark, sf_dir):
    points = points_long(spark, sf_dir)
    hourly = points.groupBy(
        "zone", "series", F.date_trunc("hour", "utc_timestamp").cast("timestamp_ntz").alias("utc_timestamp")
    ).agg((F.sum("value_c").cast("double") / 100.0).alias("value"))
    return shaping.align_wide(hourly, ["click", "error", "purchase", "signup", "view"])


@query("time_slice", with_views(
    """SELECT zone, utc_timestamp, series, value_c, event_id FROM points_long
    WHERE utc_timestamp BETWEEN timestamp '2024-01-08 00:00:00' AND timestamp '2024-01-14 23:00:00'""", "points_long"))
def time_slice(spark, sf_dir):
    sliced = shaping.time_slice(points_long(spark, sf_dir), "2024-01-08 00:00:00", "2024-01-14 23:00:00")
    return sliced.select("zone", "utc_timestamp", "series", "value_c", "event_id")


@query("sort_time", with_views(
    "SELECT zone, utc_timestamp, price_c FROM market_sparse ORDER BY zone, utc_timestamp", "market_sparse"))
def sort_time(spark, sf_dir):
    return shaping.sort_time(market_sparse(spark, sf_dir).select("zone", "utc_timestamp", "price_c"))


@query("daily_mean", with_views(
    """SELECT zone, date_trunc('day', utc_timestamp)::timestamp AS day,
      round(avg(price_c) / 100.0, 6) AS price, round(avg(load_c) / 100.0, 6) AS load
    FROM market_dense GROUP BY 1, 2""", "market_dense"))
def daily_mean(spark, sf_dir):
    daily = shaping.daily_mean(market_dense(spark, sf_dir), ["price_c", "load_c"])
    return daily.select("zone", "day", F.round(F.col("price_c") / 100.0, 6).alias("price"),
                        F.round(F.col("load_c") / 100.0, 6).alias("load"))


@query("weekly_mean", with_views(
    """SELECT zone, (date_trunc('week', utc_timestamp) + interval 6 day)::timestamp AS week_end,
      round(avg(price_c) / 100.0, 6) AS price,
      round(avg(wind_onshore_c + wind_offshore_c) / 100.0, 6) AS wind
    FROM market_dense GROUP BY 1, 2""", "market_dense"))
def weekly_mean(spark, sf_dir):
    weekly = shaping.weekly_mean(
        market_dense(spark, sf_dir), {"price": F.col("price_c"), "wind": row_sum("wind_onshore_c", "wind_offshore_c")})
    return weekly.select("zone", "week_end", F.round(F.col("price") / 100.0, 6).alias("price"),
                         F.round(F.col("wind") / 100.0, 6).alias("wind"))


@query("row_sum", with_views(
    """SELECT zone, utc_timestamp, coalesce(wind_onshore_c, 0) + coalesce(wind_offshore_c, 0) AS wind_c
    FROM market_sparse""", "market_sparse"))
def row_sum_query(spark, sf_dir):
    total = shaping.with_row_sum(market_sparse(spark, sf_dir), "wind_c", ["wind_onshore_c", "wind_offshore_c"])
    return total.select("zone", "utc_timestamp", "wind_c")


def _edge_sql(order: str, n: int) -> str:
    return with_views(
        f"""SELECT zone, utc_timestamp, {", ".join(COLUMNS)} FROM (
          SELECT *, row_number() OVER (PARTITION BY zone ORDER BY utc_timestamp {order}) AS rn FROM market_sparse)
        WHERE rn <= {n}""", "market_sparse")


@query("tail_n", _edge_sql("DESC", 100))
def tail_n(spark, sf_dir):
    return shaping.tail_rows(market_sparse(spark, sf_dir), 100)


@query("head_n", _edge_sql("ASC", 72))
def head_n(spark, sf_dir):
    return shaping.head_rows(market_sparse(spark, sf_dir), 72)


@query("local_time_fields", with_views(
    f"""SELECT zone, utc_timestamp, l AS local_ts, cast(cast(l AS date) AS varchar) AS local_date, cast(hour(l) AS int) AS local_hour,
      cast(isodow(l) - 1 AS int) AS local_weekday, cast(month(l) AS int) AS local_month, cast(day(l) AS int) AS local_day
    FROM (SELECT zone, utc_timestamp, {local_sql('utc_timestamp')} AS l FROM market_sparse)""", "market_sparse"))
def local_time_fields(spark, sf_dir):
    return shaping.with_local_fields(market_sparse(spark, sf_dir).select("zone", "utc_timestamp"))
