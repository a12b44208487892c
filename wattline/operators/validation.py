"""Hold-out split, seasonal naive forecast, walk-forward folds and error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.config import HOUR_MICROS, MARKET_TZ, PRICE, TS, ZONE
from wattline.functions.calendar import local_time, utc_floor
from wattline.functions.numbers import pinball
from wattline.plans.blocks import BLOCK_STEPS, BlockedSeries, block_series
from wattline.plans.sizes import small_side

SEASON_STEPS = 168
MIN_TRAIN_ROWS = 24 * 7
MIN_HOUR_RESIDUALS = 10
ALL_HOURS = -1


def holdout_split(df: DataFrame, months: int = 3, *, ts: str = TS, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Mark each row ``train`` or ``test``; test is later than the last timestamp minus ``months``."""
    split = df.groupBy(*keys).agg((F.max(ts) - F.make_ym_interval(months=F.lit(months))).alias("split_ts"))
    part = F.when(F.col(ts) <= F.col("split_ts"), "train").otherwise("test")
    return df.join(small_side(split), list(keys)).withColumn("part", part)


def seasonal_naive(
    df: DataFrame,
    *,
    target: str = PRICE,
    season: int = SEASON_STEPS,
    train_only: bool = False,
    step_micros: int = HOUR_MICROS,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    block_steps: int = BLOCK_STEPS,
    name: str = "y_naive",
) -> DataFrame:
    """Target exactly one season earlier, null where there is no such row.

    With ``train_only`` (needs ``part`` from :func:`holdout_split`) test targets
    stay invisible, so only the first season of the test span is forecast.
    """
    laid = block_series(
        df, keys, ts, look_back=season, mode="time", step_micros=step_micros, block_steps=block_steps
    )
    return naive_of(laid, target=target, season=season, train_only=train_only, name=name)


def naive_of(
    laid: BlockedSeries, *, target: str = PRICE, season: int = SEASON_STEPS, train_only: bool = False, name: str = "y_naive"
) -> DataFrame:
    """As :func:`seasonal_naive`, from rows that are laid out in time blocks."""
    source = F.when(F.col("part") == "train", F.col(target)) if train_only else F.col(target)
    return laid.with_columns({name: laid.lag(source, season)}).own_rows()


def fold_table(
    df: DataFrame,
    n_folds: int = 12,
    *,
    min_train_rows: int = MIN_TRAIN_ROWS,
    on_short: str = "error",
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per fold: validation month, training span and sizes.

    Fold k validates on the k-th of the last ``n_folds`` months and trains on
    all months before it. Training figures are running totals over one row per
    month, so no training row is copied into twelve folds. ``sums`` adds further
    per-row quantities whose training totals are wanted.

    A series with fewer than ``n_folds + 2`` months stops the query
    (``on_short="error"``) or is left out (``"skip"``). Folds with fewer than
    ``min_train_rows`` training rows are left out and keep their number.
    """
    sums = sums or {}
    months = df.groupBy(*keys, utc_floor("month", ts).alias("val_month")).agg(
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        F.count(F.lit(1)).alias("n_val"),
        *[F.sum(expr).alias(name) for name, expr in sums.items()],
    )
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("val_month").rowsBetween(Window.unboundedPreceding, -1)
    ranked = months.withColumns(
        {
            "fold": (F.lit(n_folds) - F.row_number().over(by_key.orderBy(F.desc("val_month")))).cast("bigint"),
            "_n_months": F.count(F.lit(1)).over(by_key),
            "train_start": F.to_date(F.min("_first").over(earlier)),
            "train_end": F.to_date(F.max("_last").over(earlier)),
            "val_start": F.to_date("_first"),
            "val_end": F.to_date("_last"),
            "n_train": F.coalesce(F.sum("n_val").over(earlier), F.lit(0)),
            **{name: F.sum(name).over(earlier) for name in sums},
        }
    )
    enough = F.col("_n_months") >= n_folds + 2
    if on_short == "error":
        message = F.format_string(f"%d months are too few for {n_folds} folds", "_n_months")
        enough = F.when(enough, True).otherwise(F.raise_error(message).cast("boolean"))
    return ranked.filter(enough & (F.col("fold") >= 0) & (F.col("n_train") >= min_train_rows)).select(
        *keys, "fold", "val_month", "train_start", "train_end", "val_start", "val_end", "n_train", "n_val", *sums
    )


def _moments(target: str, predictor: str) -> dict[str, Column]:
    x, y = F.col(predictor), F.col(target)
    return {"_sx": x, "_sy": y, "_sxx": x * x, "_sxy": x * y}


def _with_line(sums: DataFrame, count: str) -> DataFrame:
    n, sx, sy, sxx, sxy = (F.col(c).cast("double") for c in (count, "_sx", "_sy", "_sxx", "_sxy"))
    spread = n * sxx - sx * sx
    slope = F.when(spread != 0, (n * sxy - sx * sy) / spread).otherwise(F.lit(0.0))
    return (
        sums.withColumn("slope", slope)
        .withColumn("intercept", F.try_divide(sy - F.col("slope") * sx, n))
        .drop("_sx", "_sy", "_sxx", "_sxy")
    )


def linear_fit(rows: DataFrame, *, target: str, predictor: str, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Least-squares line of ``target`` on ``predictor`` per series."""
    sums = [F.sum(expr).alias(name) for name, expr in _moments(target, predictor).items()]
    return _with_line(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), *sums), "n_train")


def linear_predict(
    rows: DataFrame, lines: DataFrame, *, predictor: str, name: str = "y_pred", keys: Sequence[str] = (ZONE,)
) -> DataFrame:
    y_pred = F.col("intercept") + F.col("slope") * F.col(predictor)
    joined = rows.join(small_side(lines.select(*keys, "slope", "intercept")), list(keys))
    return joined.withColumn(name, y_pred).drop("slope", "intercept")


def linear_folds(
    df: DataFrame,
    *,
    target: str,
    predictor: str,
    n_folds: int = 12,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    **fold_options,
) -> DataFrame:
    """Fold table with the least-squares line of ``target`` on ``predictor``.

    The line follows from running totals of the training months. Rows without
    predictor or target must have been removed.
    """
    folds = fold_table(df, n_folds, ts=ts, keys=keys, sums=_moments(target, predictor), **fold_options)
    return _with_line(folds, "n_train")


def linear_fold_predictions(
    df: DataFrame,
    folds: DataFrame,
    *,
    target: str,
    predictor: str,
    scale: float = 1.0,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Validation rows of every fold with actual and forecast."""
    lines = small_side(folds.select(*keys, "fold", "val_month", "slope", "intercept"))
    y_pred = (F.col("intercept") + F.col("slope") * F.col(predictor)) / scale
    return (
        df.withColumn("val_month", utc_floor("month", ts))
        .join(lines, [*keys, "val_month"])
        .select(*keys, "fold", ts, (F.col(target) / scale).alias("y_true"), y_pred.alias("y_pred"))
    )


def error_columns(actual: str = "y_true", predicted: str = "y_pred") -> dict[str, Column]:
    error = F.col(actual) - F.col(predicted)
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "pinball_10": F.avg(pinball(F.col(actual), F.col(predicted), 0.1)),
        "pinball_90": F.avg(pinball(F.col(actual), F.col(predicted), 0.9)),
    }


def fold_metrics(predictions: DataFrame, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    return predictions.groupBy(*keys, "fold").agg(
        *[expr.alias(name) for name, expr in error_columns().items()], F.count(F.lit(1)).alias("n_val")
    )


def fold_results(predictions: DataFrame, folds: DataFrame, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Date ranges of each fold beside its error measures."""
    spans = folds.select(*keys, "fold", "train_start", "train_end", "val_start", "val_end")
    return spans.join(fold_metrics(predictions, keys), [*keys, "fold"])


def cv_summary(metrics: DataFrame, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Mean and population deviation over folds."""
    return metrics.groupBy(*keys).agg(
        F.avg("mae").alias("mae_mean"),
        F.stddev_pop("mae").alias("mae_std"),
        F.avg("rmse").alias("rmse_mean"),
        F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("pinball_10").alias("pinball_10_mean"),
        F.avg("pinball_90").alias("pinball_90_mean"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def residual_quantiles(
    predictions: DataFrame,
    *,
    q_lo: float = 0.1,
    q_hi: float = 0.9,
    min_residuals: int = MIN_HOUR_RESIDUALS,
    ts: str = TS,
    tz: str = MARKET_TZ,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Residual quantiles per local hour with more than ``min_residuals`` rows,
    and over all hours (hour -1).

    A group holds the validation rows of one series, at most one month of hours
    per fold, so the exact built-in percentile stays small.
    """
    residual = F.col("y_true") - F.col("y_pred")
    hours = F.explode(F.array(F.hour(local_time(ts, tz)), F.lit(ALL_HOURS)))
    grouped = predictions.select(*keys, hours.alias("local_hour"), residual.alias("_r")).groupBy(*keys, "local_hour")
    quantiles = grouped.agg(
        F.percentile("_r", F.array(F.lit(q_lo), F.lit(q_hi))).alias("_q"), F.count("_r").alias("n_residuals")
    )
    return quantiles.filter((F.col("local_hour") == ALL_HOURS) | (F.col("n_residuals") > min_residuals)).select(
        *keys, "local_hour", F.col("_q")[0].alias("q_lo"), F.col("_q")[1].alias("q_hi"), "n_residuals"
    )


def prediction_interval(
    forecast: DataFrame,
    quantiles: DataFrame,
    *,
    point: str = "y_pred",
    ts: str = TS,
    tz: str = MARKET_TZ,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Add ``y_pred_p10`` and ``y_pred_p90``: point plus the offset of its hour,
    or of all hours where the hour has none."""
    offsets = quantiles.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("local_hour", F.struct("q_lo", "q_hi")))).alias("_offsets")
    )
    hour = F.hour(local_time(ts, tz))
    own, every = F.try_element_at("_offsets", hour), F.try_element_at("_offsets", F.lit(ALL_HOURS))
    joined = forecast.join(small_side(offsets), list(keys), "left").withColumn("_o", F.coalesce(own, every))
    return joined.withColumns(
        {"y_pred_p10": F.col(point) + F.col("_o.q_lo"), "y_pred_p90": F.col(point) + F.col("_o.q_hi")}
    ).drop("_o", "_offsets")


def interval_coverage(
    forecast: DataFrame,
    *,
    actual: str = "y_true",
    low: str = "y_pred_p10",
    high: str = "y_pred_p90",
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Share of rows inside the interval, ends included; a missing bound counts as outside."""
    inside = F.coalesce(F.col(actual).between(F.col(low), F.col(high)), F.lit(False))
    return forecast.groupBy(*keys).agg(
        F.avg(inside.cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_hours")
    )


def compare_models(
    scored: DataFrame,
    *,
    actual: str = "y_true",
    model: str = "y_pred",
    baseline: str = "y_naive",
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Test errors of model and baseline with the rows each is scored on.

    Each mean skips its own nulls. ``common_improvement_pct`` uses only rows
    that both forecast. Improvement over a faultless baseline is null.
    """
    model_error = F.col(actual) - F.col(model)
    base_error = F.col(actual) - F.col(baseline)
    both = model_error.isNotNull() & base_error.isNotNull()
    return (
        scored.groupBy(*keys)
        .agg(
            F.avg(F.abs(base_error)).alias("baseline_mae"),
            F.count(base_error).alias("baseline_n_scored"),
            F.avg(F.abs(model_error)).alias("model_mae"),
            F.sqrt(F.avg(model_error * model_error)).alias("model_rmse"),
            F.count(model_error).alias("model_n_scored"),
            F.avg(F.when(both, F.abs(base_error))).alias("_common_base"),
            F.avg(F.when(both, F.abs(model_error))).alias("_common_model"),
        )
        .withColumn("improvement_pct", (1 - F.try_divide("model_mae", "baseline_mae")) * 100)
        .withColumn("common_improvement_pct", (1 - F.try_divide("_common_model", "_common_base")) * 100)
        .drop("_common_base", "_common_model")
    )


def performance_record(
    scored: DataFrame, metrics: DataFrame, *, ts: str = TS, keys: Sequence[str] = (ZONE,)
) -> DataFrame:
    """One row per series: test errors, interval coverage, fold summary, test window."""
    window = scored.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("test_start"), F.to_date(F.max(ts)).alias("test_end"))
    on = list(keys)
    return (
        compare_models(scored, keys=keys)
        .join(interval_coverage(scored, keys=keys), on)
        .join(window, on)
        .join(cv_summary(metrics, keys), on, "left")
    )


def forecast_output(forecast: DataFrame, *, digits: int | None = 2, ts: str = TS, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Delivery format of the forecast: ISO id and three values."""
    values = ("y_pred", "y_pred_p10", "y_pred_p90")
    shown = [(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in values]
    return forecast.select(*keys, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("id"), *shown)
