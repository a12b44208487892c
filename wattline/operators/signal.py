"""Fair value against a reference price: direction, shape and desk texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wattline.config import PRICE, TS, ZONE
from wattline.operators.delivery import horizon_rank
from wattline.plans.blocks import edge_rows
from wattline.plans.sizes import small_side

REFERENCE_ROWS = 720
DEFAULT_THRESHOLD = 30.0
BUY_PEAK_ABOVE = 5.0
FLATTEN_BELOW = 2.0
DRIFT_FACTOR = 2.0

# Texts of the signal record.
INVALIDATION_TEXTS = (
    "Unplanned nuclear outage (>1 GW) announcement within 4 hours of gate closure",
    "Extreme cold snap (load +15% vs forecast) not captured in fundamentals",
    "Wind drought: generation <30% of installed capacity for ≥3 consecutive days",
    "Cross-border congestion causing price zone split from NL/FR >€20/MWh",
)
DRIFT_TEXT = "Model out-of-sample MAE > 2× training MAE (%.0f EUR/MWh) → reduce position to 0"
DESK_TEXTS = (
    "Express directional bias via prompt month baseload futures (EEX)",
    "Express shape via peak/offpeak spread products (EEX Peak/Offpeak)",
    "Size position by band_width: narrower band → larger position",
)


def prompt_reference(
    prices: DataFrame,
    forecast: DataFrame,
    *,
    n_ref: int = REFERENCE_ROWS,
    price: str = PRICE,
    digits: int | None = None,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Mean of the last ``n_ref`` known prices before the forecast starts, null if fewer.

    One row per forecast series.
    """
    starts = forecast.groupBy(*keys).agg(F.min(ts).alias("_start"))
    starts = small_side(starts)
    prior = (
        prices.select(*keys, ts, price)
        .filter(F.col(price).isNotNull())
        .join(starts, list(keys))
        .filter(F.col(ts) < F.col("_start"))
        .drop("_start")
    )
    mean = F.avg(price)
    mean = F.round(mean, digits) if digits is not None else mean
    reference = (
        edge_rows(prior, keys, ts, n_ref, last=True)
        .groupBy(*keys)
        .agg(F.when(F.count(price) == n_ref, mean).alias("reference_price"), F.count(price).alias("n_reference"))
    )
    return starts.drop("_start").join(reference, list(keys), "left").withColumn(
        "n_reference", F.coalesce("n_reference", F.lit(0)).cast("bigint")
    )


def _full_periods(views: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All products of the periods whose base view has every hour."""
    hours_in_month = F.dayofmonth(F.last_day("start")) * 24
    whole = F.when(F.col("horizon") == "week", 168).when(F.col("horizon") == "month", hours_in_month).otherwise(24)
    stem = F.regexp_replace("period_label", "-[a-z]+$", "")
    staged = views.withColumn("_stem", stem)
    full = staged.filter((F.col("product_type") == "base") & (F.col("n_hours") == whole))
    return staged.join(full.select(*keys, "horizon", "_stem"), [*keys, "horizon", "_stem"], "left_semi").drop("_stem")


def primary_rows(views: DataFrame, product: str, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """First view of a product: weekly before monthly, then by start.

    A series has few views, so ranking them is small.
    """
    chosen = views.filter(F.col("product_type") == product)
    order = Window.partitionBy(*keys).orderBy(horizon_rank(), "start")
    return chosen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def trading_signal(
    views: DataFrame,
    references: DataFrame,
    thresholds: DataFrame | None = None,
    *,
    full_periods_only: bool = False,
    default_threshold: float = DEFAULT_THRESHOLD,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Directional and shape signal per series.

    ``thresholds`` holds ``mae`` and optionally ``train_mae`` per series; a
    series without one gets the default. A series with a reference but no base
    view is reported as ``no_data``. The first view is often a partial period;
    ``full_periods_only`` skips those.
    """
    on = list(keys)
    if full_periods_only:
        views = _full_periods(views, keys)
    base = primary_rows(views, "base", keys).select(
        *keys,
        F.col("period_label").alias("period"),
        F.col("forecast_mean_eur_mwh").alias("forecast_base_eur_mwh"),
        F.col("forecast_p10").alias("band_low"),
        F.col("forecast_p90").alias("band_high"),
    )
    peak = primary_rows(views, "peak", keys).select(*keys, F.col("forecast_mean_eur_mwh").alias("_peak"))
    joined = references.join(base, on, "full").join(peak, on, "left")
    if thresholds is None:
        joined = joined.withColumns({"mae": F.lit(None).cast("double"), "train_mae": F.lit(None).cast("double")})
    else:
        if "train_mae" not in thresholds.columns:
            thresholds = thresholds.withColumn("train_mae", F.lit(None).cast("double"))
        joined = joined.join(thresholds.select(*keys, "mae", "train_mae"), on, "left")
    limit = F.coalesce("mae", F.lit(default_threshold))
    gap = F.col("forecast_base_eur_mwh") - F.col("reference_price")
    direction = (
        F.when(F.col("period").isNull(), "no_data")
        .when(gap > limit, "long")
        .when(gap < -limit, "short")
        .otherwise("neutral")
    )
    spread = F.col("_peak") - F.col("forecast_base_eur_mwh")
    action = (
        F.when(spread > BUY_PEAK_ABOVE, "buy peak vs base")
        .when(spread < FLATTEN_BELOW, "flatten shape")
        .when(spread.isNotNull(), "hold")
    )
    return joined.select(
        *keys,
        "period",
        "forecast_base_eur_mwh",
        F.col("reference_price").alias("current_prompt_price_eur_mwh"),
        "band_low",
        "band_high",
        (F.col("band_high") - F.col("band_low")).alias("band_width_eur_mwh"),
        limit.alias("model_mae_threshold_eur_mwh"),
        gap.alias("difference_eur_mwh"),
        direction.alias("direction"),
        spread.alias("peak_vs_base_spread_eur_mwh"),
        action.alias("peak_action"),
        F.coalesce(F.col("mae") > F.lit(DRIFT_FACTOR) * F.col("train_mae"), F.lit(False)).alias("mae_drift_stop"),
    )


def signal_record(signal: DataFrame, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Signal with its nested fields and texts, ready for the JSON sink."""
    value, price = F.col("forecast_base_eur_mwh"), F.col("current_prompt_price_eur_mwh")
    gap, limit = F.col("difference_eur_mwh"), F.col("model_mae_threshold_eur_mwh")
    spread, action = F.col("peak_vs_base_spread_eur_mwh"), F.col("peak_action")
    reason = (
        F.when(F.col("direction") == "no_data", "No base delivery views available")
        .when(price.isNull(), "No current prompt price provided; cannot compute directional signal")
        .when(
            F.col("direction") == "long",
            F.format_string(
                "Fair value %.1f exceeds prompt %.1f by %.1f EUR/MWh (>%.1f MAE threshold) → buy prompt base",
                value, price, gap, limit,
            ),
        )
        .when(
            F.col("direction") == "short",
            F.format_string(
                "Fair value %.1f below prompt %.1f by %.1f EUR/MWh → sell prompt base", value, price, F.abs(gap)
            ),
        )
        .otherwise(
            F.format_string("Forecast %.1f within ±MAE of prompt %.1f → no directional edge", value, price)
        )
    )
    shape = F.when(spread.isNotNull(), F.format_string("Peak/base spread forecast: %.1f EUR/MWh → %s", spread, action))
    drift = F.format_string(DRIFT_TEXT, limit * DRIFT_FACTOR)
    return signal.select(
        *keys,
        "period",
        "forecast_base_eur_mwh",
        F.round(price, 2).alias("current_prompt_price_eur_mwh"),
        F.array("band_low", "band_high").alias("confidence_band"),
        F.round("band_width_eur_mwh", 2).alias("band_width_eur_mwh"),
        F.round(limit, 2).alias("model_mae_threshold_eur_mwh"),
        "direction",
        F.when(
            spread.isNotNull(),
            F.struct(F.round(spread, 2).alias("peak_vs_base_spread_eur_mwh"), action.alias("action")),
        ).alias("peak_spread"),
        F.array_compact(F.array(reason, shape)).alias("reasoning"),
        F.array(*[F.lit(t) for t in INVALIDATION_TEXTS], drift).alias("invalidation_conditions"),
        F.array(*[F.lit(t) for t in DESK_TEXTS]).alias("desk_actions"),
        "mae_drift_stop",
    )
