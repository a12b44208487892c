from pyspark.sql import functions as F

from checks.fixtures import forecast_from, forecast_hourly, local_sql, market_dense, with_views
from checks.registry import query
from wattline.operators import delivery, reports, signal, validation
from wattline.session import scratch_path, settle
from wattline.sources import tables

_L = local_sql("utc_timestamp")
_PEAK = f"(isodow({_L}) <= 5 AND hour({_L}) BETWEEN 8 AND 19)"
_VIEW = ("forecast_mean_eur_mwh", "forecast_p10", "forecast_p90")


def _euro(df, columns=_VIEW, digits=6):
    return df.withColumns({c: F.round(F.col(c) / 100.0, digits) for c in columns})


@query("peak_flag", with_views(
    f"SELECT zone, utc_timestamp, {_PEAK} AS is_peak FROM market_dense", "market_dense"))
def peak_flag(spark, sf_dir):
    return delivery.with_peak_flag(market_dense(spark, sf_dir).select("zone", "utc_timestamp"))


@query("daily_blocks", with_views(
    f"""SELECT zone, cast(cast({_L} AS date) AS varchar) AS date, round(avg(y_pred) / 100.0, 6) AS base_avg,
      round(avg(y_pred) FILTER ({_PEAK}) / 100.0, 6) AS peak_avg,
      round(avg(y_pred) FILTER (NOT {_PEAK}) / 100.0, 6) AS offpeak_avg,
      round((avg(y_pred) FILTER ({_PEAK}) - avg(y_pred) FILTER (NOT {_PEAK})) / 100.0, 6) AS peak_spread
    FROM forecast_hourly GROUP BY 1, 2""", "forecast_hourly"))
def daily_blocks(spark, sf_dir):
    blocks = delivery.daily_blocks(forecast_hourly(spark, sf_dir))
    return _euro(blocks, ("base_avg", "peak_avg", "offpeak_avg", "peak_spread"))


_WEEK_END = "(date_trunc('week', utc_timestamp - interval 1 day) + interval 7 day)"
_PERIODS = {
    "week": f"strftime({_WEEK_END}, '%Y-W%W')",
    "month": "strftime(utc_timestamp, '%Y-%m')",
    "day": "strftime(utc_timestamp, '%Y-%m-%d')",
}


def _views_sql(horizon: str, band: bool = True, digits: int | None = 6, source: str = "forecast_hourly") -> str:
    mean = "avg(y_pred) / 100.0"
    low, high = ("avg(y_pred_p10) / 100.0", "avg(y_pred_p90) / 100.0") if band else (
        "quantile_cont(y_pred, 0.1) / 100.0", "quantile_cont(y_pred, 0.9) / 100.0")
    if digits is not None:
        mean, low, high = (f"round({x}, {digits})" for x in (mean, low, high))
    return f"""SELECT zone, '{horizon}' AS horizon, concat({_PERIODS[horizon]}, '-', product_type) AS period_label,
      min(utc_timestamp) AS start, max(utc_timestamp) AS "end", product_type, {mean} AS forecast_mean_eur_mwh,
      {low} AS forecast_p10, {high} AS forecast_p90, count(*) AS n_hours
    FROM (SELECT *, 'base' AS product_type FROM {source}
          UNION ALL SELECT *, CASE WHEN {_PEAK} THEN 'peak' ELSE 'offpeak' END FROM {source})
    GROUP BY zone, product_type, {_PERIODS[horizon]} HAVING count(*) >= 2"""


def _views_query(name, horizon, band=True):
    @query(name, with_views(_views_sql(horizon, band), "forecast_hourly"))
    def views(spark, sf_dir):
        bounds = ("y_pred_p10", "y_pred_p90") if band else None
        return _euro(delivery.delivery_views(forecast_hourly(spark, sf_dir), horizon, bounds=bounds))


_views_query("delivery_views_week", "week")
_views_query("delivery_views_month", "month")
_views_query("delivery_views_day", "day")
_views_query("delivery_views_percentile", "week", band=False)

_ALL = f"views AS ({_views_sql('week', digits=None)} UNION ALL {_views_sql('month', digits=None)})"


@query("delivery_views_all", with_views(
    f"{_views_sql('week')} UNION ALL {_views_sql('month')}", "forecast_hourly"))
def delivery_views_all(spark, sf_dir):
    return _euro(delivery.all_views(forecast_hourly(spark, sf_dir)))


@query("delivery_by_product", with_views(
    """SELECT zone, period_label AS period, round(forecast_mean_eur_mwh, 6) AS fair_value_eur_mwh, n_hours AS hours
    FROM views WHERE product_type = 'peak'""", "forecast_hourly", steps=_ALL))
def delivery_by_product(spark, sf_dir):
    return delivery.by_product(_euro(delivery.all_views(forecast_hourly(spark, sf_dir))), "peak")


@query("weekly_fair_value", with_views(_views_sql("week", band=False, source="naive"), "market_dense", steps="""
naive AS (
  SELECT a.zone, a.utc_timestamp, b.price_c AS y_pred FROM market_dense a JOIN market_dense b
    ON b.zone = a.zone AND b.utc_timestamp = a.utc_timestamp - interval 168 hour WHERE b.price_c IS NOT NULL)"""))
def weekly_fair_value(spark, sf_dir):
    """Events to hourly market table to seasonal-naive forecast to weekly products."""
    naive = validation.seasonal_naive(market_dense(spark, sf_dir), target="price_c", name="y_pred")
    known = naive.filter(F.col("y_pred").isNotNull()).select("zone", "utc_timestamp", "y_pred")
    return _euro(delivery.delivery_views(known, "week", bounds=None))


N_REF = 168
_REFERENCE = f"""
starts AS (SELECT zone, min(utc_timestamp) AS s FROM forecast_hourly GROUP BY 1),
prior AS (
  SELECT m.zone, m.price_c, row_number() OVER (PARTITION BY m.zone ORDER BY m.utc_timestamp DESC) AS rn
  FROM market_dense m JOIN starts USING (zone) WHERE m.utc_timestamp < s AND m.price_c IS NOT NULL),
refs AS (
  SELECT s.zone, CASE WHEN count(price_c) = {{n}} THEN avg(price_c) / 100.0 END AS reference_price,
         count(price_c) AS n_reference
  FROM starts s LEFT JOIN prior p ON p.zone = s.zone AND rn <= {{n}} GROUP BY 1)"""


def _stored(spark, sf_dir):
    """Prices and forecast; several steps read them, so they are stored first."""
    prices = settle(spark, market_dense(spark, sf_dir).select("zone", "utc_timestamp", "price_c"), "market-dense")
    return prices, settle(spark, forecast_from(prices), "forecast")


def _reference(prices, forecast):
    reference = signal.prompt_reference(prices, forecast, n_ref=N_REF, price="price_c")
    return reference.withColumn("reference_price", F.col("reference_price") / 100.0)


@query("prompt_reference_hourly", with_views(
    "SELECT zone, round(reference_price, 6) AS reference_price, n_reference FROM refs",
    "forecast_hourly", steps=_REFERENCE.format(n=N_REF)))
def prompt_reference_hourly(spark, sf_dir):
    return _reference(*_stored(spark, sf_dir)).withColumn("reference_price", F.round("reference_price", 6))


_SIGNAL = f"""{_REFERENCE.format(n=N_REF).strip()},
{_ALL},
errors AS (SELECT zone, avg(abs(y_true - y_pred)) / 100.0 AS mae FROM forecast_hourly GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY zone, product_type
             ORDER BY CASE horizon WHEN 'week' THEN 0 ELSE 1 END, start) AS rn FROM views),
signals AS (
  SELECT r.zone, b.period_label AS period, b.forecast_mean_eur_mwh AS base, r.reference_price AS ref,
    b.forecast_p10 AS lo, b.forecast_p90 AS hi, e.mae, p.forecast_mean_eur_mwh - b.forecast_mean_eur_mwh AS spread
  FROM refs r JOIN ranked b ON b.zone = r.zone AND b.rn = 1 AND b.product_type = 'base'
  LEFT JOIN ranked p ON p.zone = r.zone AND p.rn = 1 AND p.product_type = 'peak'
  LEFT JOIN errors e ON e.zone = r.zone)"""


def _signal(spark, sf_dir):
    prices, forecast = _stored(spark, sf_dir)
    views = delivery.all_views(forecast)
    views = views.withColumns({c: F.col(c) / 100.0 for c in _VIEW})
    mae = forecast.groupBy("zone").agg((F.avg(F.abs(F.col("y_true") - F.col("y_pred"))) / 100.0).alias("mae"))
    mae = mae.withColumn("train_mae", F.col("mae") * 0.4)
    return signal.trading_signal(views, _reference(prices, forecast), mae)


@query("trading_signal", with_views(
    """SELECT zone, period, round(base, 6) AS forecast_base_eur_mwh, round(ref, 6) AS current_prompt_price_eur_mwh,
      round(lo, 6) AS band_low, round(hi, 6) AS band_high, round(hi - lo, 6) AS band_width_eur_mwh,
      round(mae, 6) AS model_mae_threshold_eur_mwh,
      CASE WHEN base - ref > mae THEN 'long' WHEN base - ref < -mae THEN 'short' ELSE 'neutral' END AS direction,
      true AS mae_drift_stop
    FROM signals""", "forecast_hourly", steps=_SIGNAL))
def trading_signal(spark, sf_dir):
    found = _signal(spark, sf_dir).drop("difference_eur_mwh", "peak_vs_base_spread_eur_mwh", "peak_action")
    numbers = [c for c, kind in found.dtypes if kind == "double"]
    return found.withColumns({c: F.round(c, 6) for c in numbers})


@query("peak_spread_signal", with_views(
    """SELECT zone, period, round(spread, 6) AS peak_vs_base_spread_eur_mwh,
      CASE WHEN spread > 5 THEN 'buy peak vs base' WHEN spread < 2 THEN 'flatten shape'
           WHEN spread IS NOT NULL THEN 'hold' END AS peak_action FROM signals""",
    "forecast_hourly", steps=_SIGNAL))
def peak_spread_signal(spark, sf_dir):
    found = _signal(spark, sf_dir).select("zone", "period", "peak_vs_base_spread_eur_mwh", "peak_action")
    return found.withColumn("peak_vs_base_spread_eur_mwh", F.round("peak_vs_base_spread_eur_mwh", 6))


_REASON = """CASE WHEN ref IS NULL THEN 'No current prompt price provided; cannot compute directional signal'
  WHEN base - ref > mae THEN printf('Fair value %.1f exceeds prompt %.1f by %.1f EUR/MWh (>%.1f MAE threshold) → buy prompt base', base, ref, base - ref, mae)
  WHEN base - ref < -mae THEN printf('Fair value %.1f below prompt %.1f by %.1f EUR/MWh → sell prompt base', base, ref, ref - base)
  ELSE printf('Forecast %.1f within ±MAE of prompt %.1f → no directional edge', base, ref) END"""


@query("signal_record", with_views(
    f"""SELECT zone, period, {_REASON} AS reason,
      CASE WHEN spread IS NOT NULL THEN printf('Peak/base spread forecast: %.1f EUR/MWh → %s', spread,
        CASE WHEN spread > 5 THEN 'buy peak vs base' WHEN spread < 2 THEN 'flatten shape' ELSE 'hold' END) END AS shape,
      printf('Model out-of-sample MAE > 2× training MAE (%.0f EUR/MWh) → reduce position to 0', 2 * mae) AS drift,
      8::bigint AS n_texts
    FROM signals""", "forecast_hourly", steps=_SIGNAL))
def signal_record(spark, sf_dir):
    record = signal.signal_record(_signal(spark, sf_dir))
    texts = F.size("invalidation_conditions") + F.size("desk_actions")
    return record.select(
        "zone",
        "period",
        F.col("reasoning")[0].alias("reason"),
        F.try_element_at("reasoning", F.lit(2)).alias("shape"),
        F.element_at("invalidation_conditions", -1).alias("drift"),
        texts.cast("bigint").alias("n_texts"),
    )


@query("forecast_output", with_views(
    """SELECT zone, strftime(utc_timestamp, '%Y-%m-%dT%H:%M:%SZ') AS id, y_pred / 100.0 AS y_pred,
      y_pred_p10 / 100.0 AS y_pred_p10, y_pred_p90 / 100.0 AS y_pred_p90 FROM forecast_hourly""", "forecast_hourly"))
def forecast_output(spark, sf_dir):
    forecast = forecast_hourly(spark, sf_dir)
    euro = forecast.withColumns({c: F.col(c) / 100.0 for c in ("y_pred", "y_pred_p10", "y_pred_p90")})
    return validation.forecast_output(euro)


@query("forecast_summary", with_views(
    """SELECT zone, count(*) AS hours, round(avg(y_pred) / 100.0, 6) AS mean_forecast,
      min(y_pred) / 100.0 AS min_forecast, max(y_pred) / 100.0 AS max_forecast FROM forecast_hourly GROUP BY 1""",
    "forecast_hourly"))
def forecast_summary(spark, sf_dir):
    summary = reports.forecast_summary(forecast_hourly(spark, sf_dir))
    return _euro(summary, ("mean_forecast", "min_forecast", "max_forecast"))


@query("weekly_price_renewables", with_views(
    """SELECT zone, (date_trunc('week', utc_timestamp) + interval 6 day)::timestamp AS week_end,
      round(avg(price_c), 6) AS price_mean, round(avg(wind_onshore_c + wind_offshore_c) / 1000, 6) AS wind_gwh,
      round(avg(solar_c) / 1000, 6) AS solar_gwh FROM market_dense GROUP BY 1, 2""", "market_dense"))
def weekly_price_renewables(spark, sf_dir):
    weekly = reports.weekly_price_renewables(
        market_dense(spark, sf_dir), price="price_c", wind=("wind_onshore_c", "wind_offshore_c"), solar="solar_c")
    return weekly.withColumns({c: F.round(c, 6) for c in ("price_mean", "wind_gwh", "solar_gwh")})


@query("price_heatmap", with_views(
    f"SELECT zone, cast(hour({_L}) AS int) AS hour, " + ", ".join(
        f'round(avg(price_c) FILTER (month({_L}) = {m}) / 100.0, 6) AS "{name}"'
        for m, name in enumerate(reports.MONTHS, 1))
    + " FROM market_dense GROUP BY 1, 2", "market_dense"))
def price_heatmap(spark, sf_dir):
    heat = reports.price_heatmap(market_dense(spark, sf_dir), price="price_c")
    return _euro(heat, reports.MONTHS)


@query("csv_roundtrip", with_views(
    """SELECT zone, utc_timestamp, y_pred / 100.0 AS y_pred, y_pred_p10 / 100.0 AS y_pred_p10,
      y_pred_p90 / 100.0 AS y_pred_p90 FROM forecast_hourly""", "forecast_hourly"))
def csv_roundtrip(spark, sf_dir):
    """Forecast written as CSV in the shared folder and read back."""
    path = scratch_path(spark, "forecast-csv")
    tables.write_csv(forecast_output(spark, sf_dir), path)
    return tables.read_forecast(spark, path)
