"""Base, peak and off-peak delivery products from hourly forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wattline.config import MARKET_TZ, TS, ZONE
from wattline.functions.calendar import delivery_week_end, delivery_week_label, is_peak, local_time, utc_floor

PRODUCTS = ("base", "peak", "offpeak")
MIN_HOURS = 2
_HORIZON_RANK = {"week": 0, "month": 1, "day": 2}


def with_peak_flag(df: DataFrame, *, ts: str = TS, tz: str = MARKET_TZ) -> DataFrame:
    return df.withColumn("is_peak", is_peak(ts, tz))


def daily_blocks(
    df: DataFrame, value: str = "y_pred", *, ts: str = TS, tz: str = MARKET_TZ, keys: Sequence[str] = (ZONE,)
) -> DataFrame:
    """Base, peak and off-peak mean per local day; no peak at weekends."""
    peak = is_peak(ts, tz)
    return (
        df.groupBy(*keys, F.to_date(local_time(ts, tz)).alias("date"))
        .agg(
            F.avg(value).alias("base_avg"),
            F.avg(F.when(peak, F.col(value))).alias("peak_avg"),
            F.avg(F.when(~peak, F.col(value))).alias("offpeak_avg"),
        )
        .withColumn("peak_spread", F.col("peak_avg") - F.col("offpeak_avg"))
    )


def _period(horizon: str, ts: str) -> Column:
    """Grouping value of a delivery period; unknown horizons mean week."""
    if horizon in ("month", "day"):
        return utc_floor(horizon, ts)
    return delivery_week_end(ts)


def _label(horizon: str, period: str) -> Column:
    return (
        F.when(F.col(horizon) == "month", F.date_format(period, "yyyy-MM"))
        .when(F.col(horizon) == "day", F.date_format(period, "yyyy-MM-dd"))
        .otherwise(delivery_week_label(F.col(period)))
    )


def all_views(
    forecast: DataFrame,
    horizons: Sequence[str] = ("week", "month"),
    *,
    value: str = "y_pred",
    bounds: tuple[str, str] | None = ("y_pred_p10", "y_pred_p90"),
    digits: int | None = None,
    ts: str = TS,
    tz: str = MARKET_TZ,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """One row per horizon, UTC period and product with at least two hours.

    Each hour belongs to base and to one of peak or off-peak in every horizon.
    It is multiplied accordingly, grouped once for all horizons, and combined on
    the map side. With ``bounds`` the band is the mean of the hourly bounds;
    without, it is the 10 % / 90 % quantile of the hourly values (a group has at
    most the hours of one period).
    """
    shaped = F.when(is_peak(ts, tz), "peak").otherwise("offpeak")
    # Unknown names mean week; a horizon that is meant twice counts once.
    meant = dict.fromkeys(horizon if horizon in _HORIZON_RANK else "week" for horizon in horizons)
    places = F.array(
        *[
            F.struct(
                F.lit(horizon).alias("horizon"),
                _period(horizon, ts).alias("_period"),
                product.alias("product_type"),
            )
            for horizon in meant
            for product in (F.lit("base"), shaped)
        ]
    )
    hours = forecast.select(*keys, ts, value, *(bounds or ()), F.inline(places))
    if bounds:
        low, high = F.avg(bounds[0]), F.avg(bounds[1])
    else:
        quantiles = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
        low, high = quantiles[0], quantiles[1]
    grouped = hours.groupBy(*keys, "horizon", "_period", "product_type").agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.avg(value).alias("forecast_mean_eur_mwh"),
        low.alias("forecast_p10"),
        high.alias("forecast_p90"),
        F.count(F.lit(1)).alias("n_hours"),
    )
    views = grouped.filter(F.col("n_hours") >= MIN_HOURS).select(
        *keys,
        "horizon",
        F.concat_ws("-", _label("horizon", "_period"), "product_type").alias("period_label"),
        "start",
        "end",
        "product_type",
        "forecast_mean_eur_mwh",
        "forecast_p10",
        "forecast_p90",
        "n_hours",
    )
    return views if digits is None else round_views(views, digits)


def delivery_views(forecast: DataFrame, horizon: str = "week", **options) -> DataFrame:
    """Views of one horizon; see :func:`all_views`."""
    return all_views(forecast, (horizon,), **options)


def round_views(views: DataFrame, digits: int = 2) -> DataFrame:
    measures = ("forecast_mean_eur_mwh", "forecast_p10", "forecast_p90")
    return views.withColumns({c: F.round(c, digits) for c in measures})


def horizon_rank(column: str = "horizon") -> Column:
    """Weekly views come before monthly ones."""
    ranks = F.create_map(*[F.lit(v) for pair in _HORIZON_RANK.items() for v in pair])
    return ranks[F.col(column)]


def by_product(views: DataFrame, product: str, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Display table of one product; base also shows its band."""
    if product not in PRODUCTS:
        raise ValueError(f"product must be one of {PRODUCTS}, not {product!r}")
    columns = [F.col("period_label").alias("period"), F.col("forecast_mean_eur_mwh").alias("fair_value_eur_mwh")]
    if product == "base":
        columns += [F.col("forecast_p10").alias("p10_eur_mwh"), F.col("forecast_p90").alias("p90_eur_mwh")]
    return views.filter(F.col("product_type") == product).select(*keys, *columns, F.col("n_hours").alias("hours"))
