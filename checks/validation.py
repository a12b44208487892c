from pyspark.sql import functions as F

from checks.fixtures import DAY_MICROS, daily_series, local_sql, market_dense, with_views
from checks.registry import query
from wattline.operators import features, learners, least_squares, reports, signal, validation
from wattline.plans.blocks import block_series
from wattline.session import settle

SEASON = 7
FOLDS = 12
MONTHS = 3

_BASE = """
base AS (
  SELECT a.zone, a.utc_timestamp, cast(a.y_c AS bigint) AS y, cast(b.y_c AS bigint) AS x
  FROM daily_series a JOIN daily_series b ON b.zone = a.zone AND b.utc_timestamp = a.utc_timestamp - interval 7 day),
split AS (SELECT zone, max(utc_timestamp) - interval 3 month AS split_ts FROM base GROUP BY 1),
train AS (SELECT base.* FROM base JOIN split USING (zone) WHERE utc_timestamp <= split_ts),
test AS (SELECT base.* FROM base JOIN split USING (zone) WHERE utc_timestamp > split_ts)"""
_FOLDS = f"""{_BASE.strip()},
months AS (
  SELECT zone, cast(date_trunc('month', utc_timestamp) AS timestamp) AS val_month, min(utc_timestamp) AS f,
    max(utc_timestamp) AS l, count(*) AS n_val, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy
  FROM train GROUP BY 1, 2),
running AS (
  SELECT zone, {FOLDS} - row_number() OVER (PARTITION BY zone ORDER BY val_month DESC) AS fold, val_month,
    cast(cast(min(f) OVER w AS date) AS varchar) AS train_start, cast(cast(max(l) OVER w AS date) AS varchar) AS train_end, cast(cast(f AS date) AS varchar) AS val_start,
    cast(cast(l AS date) AS varchar) AS val_end, cast(sum(n_val) OVER w AS bigint) AS n_train, n_val,
    cast(sum(n_val) OVER w AS double) AS n, cast(sum(sx) OVER w AS double) AS sx, cast(sum(sy) OVER w AS double) AS sy,
    cast(sum(sxx) OVER w AS double) AS sxx, cast(sum(sxy) OVER w AS double) AS sxy
  FROM months WINDOW w AS (PARTITION BY zone ORDER BY val_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
slopes AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM running WHERE fold >= 0 AND n_train >= 168),
folds AS (SELECT *, (sy - slope * sx) / n AS intercept FROM slopes)"""
_CV = f"""{_FOLDS.strip()},
cv AS (
  SELECT t.zone, f.fold, t.utc_timestamp, t.y / 100.0::double AS y_true,
    (intercept + slope * t.x) / 100.0::double AS y_pred
  FROM train t JOIN folds f ON f.zone = t.zone AND f.val_month = date_trunc('month', t.utc_timestamp)),
metrics AS (
  SELECT zone, fold, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse,
    avg(CASE WHEN y_true >= y_pred THEN 0.1::double * (y_true - y_pred) ELSE -0.9::double * (y_true - y_pred) END) AS pinball_10,
    avg(CASE WHEN y_true >= y_pred THEN 0.9::double * (y_true - y_pred) ELSE -0.1::double * (y_true - y_pred) END) AS pinball_90,
    count(*) AS n_val
  FROM cv GROUP BY 1, 2)"""
_HOUR = f"cast(hour({local_sql('utc_timestamp')}) AS int)"
_BANDS = f"""{_CV.strip()},
residuals AS (SELECT zone, {_HOUR} AS local_hour, y_true - y_pred AS r FROM cv),
bands AS (
  SELECT zone, local_hour, quantile_cont(r, 0.1) AS q_lo, quantile_cont(r, 0.9) AS q_hi, count(*) AS n_residuals
  FROM residuals GROUP BY 1, 2 HAVING count(*) > 10
  UNION ALL
  SELECT zone, -1, quantile_cont(r, 0.1), quantile_cont(r, 0.9), count(*) FROM residuals GROUP BY 1)"""
_SCORED = f"""{_BANDS.strip()},
totals AS (
  SELECT zone, cast(count(*) AS double) AS n, cast(sum(x) AS double) AS sx, cast(sum(y) AS double) AS sy,
    cast(sum(x * x) AS double) AS sxx, cast(sum(x * y) AS double) AS sxy FROM train GROUP BY 1),
final_slope AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope FROM totals),
final AS (SELECT zone, slope, (sy - slope * sx) / n AS intercept FROM final_slope),
point AS (
  SELECT t.zone, t.utc_timestamp, t.y / 100.0::double AS y_true, (intercept + slope * t.x) / 100.0::double AS y_pred,
    n.y / 100.0::double AS y_naive
  FROM test t JOIN final USING (zone)
  LEFT JOIN train n ON n.zone = t.zone AND n.utc_timestamp = t.utc_timestamp - interval 7 day),
scored AS (
  SELECT p.*, p.y_pred + coalesce(h.q_lo, g.q_lo) AS y_pred_p10, p.y_pred + coalesce(h.q_hi, g.q_hi) AS y_pred_p90
  FROM point p JOIN bands g ON g.zone = p.zone AND g.local_hour = -1
  LEFT JOIN bands h ON h.zone = p.zone AND h.local_hour = {_HOUR})"""


def _base(spark, sf_dir):
    """Daily rows with the value one season earlier, in whole cents."""
    lagged = validation.seasonal_naive(
        daily_series(spark, sf_dir), target="y_c", season=SEASON, step_micros=DAY_MICROS, name="x")
    return lagged.filter(F.col("x").isNotNull()).select(
        "zone", "utc_timestamp", F.col("y_c").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))


def _split(spark, sf_dir):
    """Stored first: the split, the folds and the final line all read it."""
    return validation.holdout_split(settle(spark, _base(spark, sf_dir), "daily-base"), MONTHS)


def _part(split, part):
    return split.filter(F.col("part") == part).drop("part", "split_ts")


def _folds(train):
    return validation.linear_folds(train, target="y", predictor="x", n_folds=FOLDS)


def _cv(spark, sf_dir, split=None):
    train = _part(split or _split(spark, sf_dir), "train")
    folds = _folds(train)
    return folds, validation.linear_fold_predictions(train, folds, target="y", predictor="x", scale=100.0)


def _scored(spark, sf_dir):
    split = _split(spark, sf_dir)
    _, cv = _cv(spark, sf_dir, split)
    naive = validation.seasonal_naive(split, target="y", season=SEASON, step_micros=DAY_MICROS, train_only=True)
    lines = validation.linear_fit(_part(split, "train"), target="y", predictor="x")
    point = validation.linear_predict(_part(naive, "test"), lines, predictor="x")
    euro = point.select(
        "zone", "utc_timestamp", *[(F.col(c) / 100.0).alias(n) for c, n in (("y", "y_true"), ("y_pred", "y_pred"), ("y_naive", "y_naive"))])
    return cv, validation.prediction_interval(euro, validation.residual_quantiles(cv))


def _round(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


def _sql(columns, table):
    return f"SELECT {columns} FROM {table}"


@query("holdout_split", with_views(
    """SELECT base.*, split_ts, CASE WHEN utc_timestamp <= split_ts THEN 'train' ELSE 'test' END AS part
    FROM base JOIN split USING (zone)""", "daily_series", steps=_BASE))
def holdout_split(spark, sf_dir):
    return _split(spark, sf_dir)


@query("seasonal_naive_rolling", with_views(
    """SELECT a.zone, a.utc_timestamp, a.price_c, b.price_c AS y_naive FROM market_dense a LEFT JOIN market_dense b
    ON b.zone = a.zone AND b.utc_timestamp = a.utc_timestamp - interval 168 hour""", "market_dense"))
def seasonal_naive_rolling(spark, sf_dir):
    prices = market_dense(spark, sf_dir).select("zone", "utc_timestamp", "price_c")
    return validation.seasonal_naive(prices, target="price_c")


@query("seasonal_naive_train_only", with_views(
    """SELECT t.zone, t.utc_timestamp, t.y, cast(n.y AS double) AS y_naive FROM test t
    LEFT JOIN train n ON n.zone = t.zone AND n.utc_timestamp = t.utc_timestamp - interval 7 day""",
    "daily_series", steps=_BASE))
def seasonal_naive_train_only(spark, sf_dir):
    naive = validation.seasonal_naive(
        _split(spark, sf_dir), target="y", season=SEASON, step_micros=DAY_MICROS, train_only=True)
    return _part(naive, "test").drop("x").withColumn("y_naive", F.col("y_naive").cast("double"))


@query("cv_folds", with_views(_sql(
    "zone, fold, val_month, train_start, train_end, val_start, val_end, n_train, n_val", "folds"),
    "daily_series", steps=_FOLDS))
def cv_folds(spark, sf_dir):
    return validation.fold_table(_part(_split(spark, sf_dir), "train"), FOLDS)


@query("cv_linear_metrics", with_views(
    """SELECT zone, fold, train_start, train_end, val_start, val_end, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
      round(pinball_10, 6) AS pinball_10, round(pinball_90, 6) AS pinball_90, m.n_val
    FROM metrics m JOIN folds f USING (zone, fold)""", "daily_series", steps=_CV))
def cv_linear_metrics(spark, sf_dir):
    folds, cv = _cv(spark, sf_dir)
    return _round(validation.fold_results(cv, folds))


@query("cv_fold_metrics", with_views(
    """SELECT zone, fold, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(pinball_10, 6) AS pinball_10,
      round(pinball_90, 6) AS pinball_90, n_val FROM metrics""", "daily_series", steps=_CV))
def cv_fold_metrics(spark, sf_dir):
    return _round(validation.fold_metrics(_cv(spark, sf_dir)[1]))


@query("cv_summary", with_views(
    """SELECT zone, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(avg(rmse), 6) AS rmse_mean,
      round(stddev_pop(rmse), 6) AS rmse_std, round(avg(pinball_10), 6) AS pinball_10_mean,
      round(avg(pinball_90), 6) AS pinball_90_mean, count(*) AS n_folds FROM metrics GROUP BY 1""",
    "daily_series", steps=_CV))
def cv_summary(spark, sf_dir):
    return _round(validation.cv_summary(validation.fold_metrics(_cv(spark, sf_dir)[1])))


@query("residual_quantiles", with_views(
    "SELECT zone, local_hour, round(q_lo, 6) AS q_lo, round(q_hi, 6) AS q_hi, n_residuals FROM bands",
    "daily_series", steps=_BANDS))
def residual_quantiles(spark, sf_dir):
    return _round(validation.residual_quantiles(_cv(spark, sf_dir)[1]))


@query("prediction_interval", with_views(
    """SELECT zone, utc_timestamp, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred, round(y_naive, 6) AS y_naive,
      round(y_pred_p10, 6) AS y_pred_p10, round(y_pred_p90, 6) AS y_pred_p90 FROM scored""",
    "daily_series", steps=_SCORED))
def prediction_interval(spark, sf_dir):
    return _round(_scored(spark, sf_dir)[1])


@query("interval_coverage", with_views(
    """SELECT zone, round(avg(CASE WHEN y_true BETWEEN y_pred_p10 AND y_pred_p90 THEN 1.0::double ELSE 0 END), 6) AS coverage,
      count(*) AS n_hours FROM scored GROUP BY 1""", "daily_series", steps=_SCORED))
def interval_coverage(spark, sf_dir):
    return _round(validation.interval_coverage(_scored(spark, sf_dir)[1]))


_COMPARED = """compared AS (
  SELECT zone, avg(abs(y_true - y_naive)) AS bm, count(y_naive) AS bn, avg(abs(y_true - y_pred)) AS mm,
    sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS mr, count(y_pred) AS mn,
    avg(abs(y_true - y_pred)) FILTER (y_naive IS NOT NULL) AS cm, min(utc_timestamp) AS f, max(utc_timestamp) AS l,
    avg(CASE WHEN y_true BETWEEN y_pred_p10 AND y_pred_p90 THEN 1.0::double ELSE 0 END) AS cover, count(*) AS hours
  FROM scored GROUP BY 1)"""
_COMPARED_COLUMNS = """round(bm, 6) AS baseline_mae, bn AS baseline_n_scored, round(mm, 6) AS model_mae,
  round(mr, 6) AS model_rmse, mn AS model_n_scored, round((1 - mm / bm) * 100, 6) AS improvement_pct,
  round((1 - cm / bm) * 100, 6) AS common_improvement_pct"""


@query("model_comparison_metrics", with_views(
    f"SELECT zone, {_COMPARED_COLUMNS} FROM compared", "daily_series", steps=f"{_SCORED.strip()},\n{_COMPARED}"))
def model_comparison_metrics(spark, sf_dir):
    return _round(validation.compare_models(_scored(spark, sf_dir)[1]))


@query("performance_record", with_views(
    f"""SELECT zone, {_COMPARED_COLUMNS}, round(cover, 6) AS coverage, hours AS n_hours, cast(cast(f AS date) AS varchar) AS test_start,
      cast(cast(l AS date) AS varchar) AS test_end, s.* EXCLUDE (zone) FROM compared JOIN (
        SELECT zone, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std,
          round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
          round(avg(pinball_10), 6) AS pinball_10_mean, round(avg(pinball_90), 6) AS pinball_90_mean,
          count(*) AS n_folds FROM metrics GROUP BY 1) s USING (zone)""",
    "daily_series", steps=f"{_SCORED.strip()},\n{_COMPARED}"))
def performance_record(spark, sf_dir):
    cv, scored = _scored(spark, sf_dir)
    return _round(validation.performance_record(scored, validation.fold_metrics(cv)))


@query("cv_recent_folds", with_views(
    """SELECT zone, fold, utc_timestamp, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM cv
    WHERE fold > (SELECT max(fold) FROM folds f WHERE f.zone = cv.zone) - 4""", "daily_series", steps=_CV))
def cv_recent_folds(spark, sf_dir):
    folds, cv = _cv(spark, sf_dir)
    return _round(reports.recent_folds(cv, folds))


@query("recent_model_comparison", with_views(
    """SELECT zone, min(utc_timestamp) AS first_hour, max(utc_timestamp) AS last_hour, count(*) AS n_common,
      round(avg(abs(y_true - y_naive)), 6) AS baseline_mae, round(avg(abs(y_true - y_pred)), 6) AS model_mae
    FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY utc_timestamp DESC) AS rn FROM scored
          WHERE y_naive IS NOT NULL AND y_pred IS NOT NULL) WHERE rn <= 336 GROUP BY 1""",
    "daily_series", steps=_SCORED))
def recent_model_comparison(spark, sf_dir):
    return _round(reports.recent_comparison(_scored(spark, sf_dir)[1]))


@query("prompt_reference", with_views(
    """SELECT zone, CASE WHEN count(y) = 720 THEN round(avg(y) / 100.0::double, 6) END AS reference_price,
      count(y) AS n_reference FROM (
        SELECT train.*, row_number() OVER (PARTITION BY zone ORDER BY utc_timestamp DESC) AS rn FROM train)
    WHERE rn <= 720 GROUP BY 1""", "daily_series", steps=_BASE))
def prompt_reference(spark, sf_dir):
    """The last 720 values before the hold-out starts."""
    split = _split(spark, sf_dir)
    reference = signal.prompt_reference(split, _part(split, "test"), price="y")
    return reference.withColumn("reference_price", F.round(F.col("reference_price") / 100.0, 6))


# Least squares with several inputs ---------------------------------------------


PENALTY = 1e9
_RIDGE_INPUTS = ("x1", "x2", "x3")
_PRODUCTS = [(a, b) for i, a in enumerate((*_RIDGE_INPUTS, "y")) for b in (*_RIDGE_INPUTS, "y")[i:]]


def _cov(a: str, b: str) -> str:
    a, b = sorted((a, b), key=(*_RIDGE_INPUTS, "y").index)
    penalty = f" + {PENALTY}::double" if a == b else ""
    return f"({a}{b} - {a} * {b} / n{penalty})"


def _determinant(columns) -> str:
    """Of the 3 x 3 system with the given right factors as columns."""
    m = [[_cov(a, b) for b in columns] for a in _RIDGE_INPUTS]
    terms = [f"{m[0][i]} * ({m[1][j]} * {m[2][k]} - {m[1][k]} * {m[2][j]})" for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    return "(" + " + ".join(terms) + ")"


_RIDGE = f"""
wide AS (
  SELECT a.zone, a.utc_timestamp, a.y_c AS y, b.y_c AS x1, c.y_c AS x2, b.n::double AS x3
  FROM daily_series a JOIN daily_series b ON b.zone = a.zone AND b.utc_timestamp = a.utc_timestamp - interval 7 day
    JOIN daily_series c ON c.zone = a.zone AND c.utc_timestamp = a.utc_timestamp - interval 28 day),
months AS (
  SELECT zone, cast(date_trunc('month', utc_timestamp) AS timestamp) AS val_month, count(*) AS n_val,
    {", ".join(f"sum({c}) AS {c}" for c in (*_RIDGE_INPUTS, "y"))}, {", ".join(f"sum({a} * {b}) AS {a}{b}" for a, b in _PRODUCTS)}
  FROM wide GROUP BY 1, 2),
running AS (
  SELECT zone, {FOLDS} - row_number() OVER (PARTITION BY zone ORDER BY val_month DESC) AS fold, val_month,
    cast(sum(n_val) OVER w AS double) AS n, {", ".join(f"sum({c}) OVER w AS {c}" for c in (*_RIDGE_INPUTS, "y", *[a + b for a, b in _PRODUCTS]))}
  FROM months WINDOW w AS (PARTITION BY zone ORDER BY val_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
weights AS (
  SELECT zone, fold, val_month, n, x1 / n AS m1, x2 / n AS m2, x3 / n AS m3, y / n AS my,
    {_determinant(("y", "x2", "x3"))} / {_determinant(_RIDGE_INPUTS)} AS w1,
    {_determinant(("x1", "y", "x3"))} / {_determinant(_RIDGE_INPUTS)} AS w2,
    {_determinant(("x1", "x2", "y"))} / {_determinant(_RIDGE_INPUTS)} AS w3
  FROM running WHERE fold >= 0 AND n >= 168),
cv AS (
  SELECT t.zone, w.fold, y / 100.0::double AS y_true, (my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3)) / 100.0::double AS y_pred
  FROM wide t JOIN weights w ON w.zone = t.zone AND w.val_month = date_trunc('month', t.utc_timestamp))"""


@query("cv_ridge_metrics", with_views(
    """SELECT zone, fold, round(avg(abs(y_true - y_pred)), 4) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) AS rmse,
    round(avg(greatest(0.1::double * (y_true - y_pred), -0.9::double * (y_true - y_pred))), 4) AS pinball_10,
    round(avg(greatest(0.9::double * (y_true - y_pred), -0.1::double * (y_true - y_pred))), 4) AS pinball_90, count(*) AS n_val
    FROM cv GROUP BY 1, 2""", "daily_series", steps=_RIDGE))
def cv_ridge_metrics(spark, sf_dir):
    """Walk-forward ridge regression on the values one and four weeks before and the number of rows one week before."""
    laid = block_series(daily_series(spark, sf_dir), ["zone"], "utc_timestamp", look_back=28, mode="time", step_micros=DAY_MICROS)
    rows = laid.with_columns({"x1": laid.lag("y_c", 7), "x2": laid.lag("y_c", 28), "x3": laid.lag("n", 7)}).own_rows()
    cv = least_squares.ridge_fold_predictions(rows, _RIDGE_INPUTS, "y_c", penalty=PENALTY, n_folds=FOLDS, scale=100.0)
    metrics = validation.fold_metrics(cv)
    return metrics.select("zone", "fold", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "pinball_10", "pinball_90")], "n_val")


# Boosted trees ---------------------------------------------------------------


#: Steps are days; nothing newer than a season enters a feature. The number of rows of a day is its fundamental.
GBT_SPEC = features.FeatureSpec(
    price="y", fundamentals=("n",), wind=(), solar="", unit="d", price_prefix="y", lags=(7, 14, 21, 28, 56), min_lag=SEASON,
    short_window=7, long_window=28, fundamental_lags=(7, 28), step_micros=DAY_MICROS)
#: The library's defaults are 800 trees of depth 6.
TREES, DEPTH = 8, 4


def _gbt_rows(spark, sf_dir):
    daily = daily_series(spark, sf_dir).select(
        "zone", "utc_timestamp", (F.floor("y_c") / 100.0).alias("y"), F.col("n").cast("double").alias("n"))
    rows = features.feature_matrix(daily, GBT_SPEC, lag_mode="time")
    return settle(spark, validation.holdout_split(rows, MONTHS), "gbt-rows")


def _forecaster(rows):
    inputs = tuple(c for c in rows.columns if c not in ("zone", "utc_timestamp", "y", "part", "split_ts"))
    small = learners.GbtSettings(iterations=TREES, depth=DEPTH)
    return learners.PriceForecaster(inputs, target="y", learner=small.estimator)


@query("gbt_forecast")
def gbt_forecast(spark, sf_dir):
    """Walk-forward boosted trees on the whole feature matrix, calibrated band and test forecast. Each of the
    12 folds and the final fit have 8 trees of depth 4 (library default 800 and 6)."""
    split = _gbt_rows(spark, sf_dir)
    train, test = _part(split, "train"), _part(split, "test")
    forecaster = _forecaster(train)
    cv = learners.walk_forward(train, forecaster)
    forecast = forecaster.fit(train).predict(test)
    banded = validation.prediction_interval(forecast, validation.residual_quantiles(cv))
    return banded.select("zone", "utc_timestamp", F.col("y").alias("y_true"), "y_pred", "y_pred_p10", "y_pred_p90")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """Importances of all inputs of the feature matrix and the zone, from 8 trees of depth 4 (library default 800 and 6)."""
    train = _part(_gbt_rows(spark, sf_dir), "train")
    return _forecaster(train).fit(train).importances()
