"""Tables behind the figures and dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattline.config import MARKET_TZ, PRICE, SOLAR, TS, WIND, ZONE
from wattline.functions.calendar import local_time
from wattline.functions.numbers import row_sum
from wattline.operators.shaping import weekly_mean
from wattline.plans.blocks import edge_rows
from wattline.plans.sizes import small_side

# Month labels.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def weekly_price_renewables(
    df: DataFrame,
    *,
    price: str = PRICE,
    wind: Sequence[str] = WIND,
    solar: str = SOLAR,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Weekly mean price, and wind and solar generation in thousands."""
    present = [c for c in wind if c in df.columns]
    columns = {"price_mean": F.col(price)}
    if present:
        columns["wind_gwh"] = row_sum(*present)
    if solar in df.columns:
        columns["solar_gwh"] = F.col(solar)
    weekly = weekly_mean(df, columns, ts=ts, keys=keys)
    return weekly.withColumns({c: F.col(c) / 1000 for c in columns if c != "price_mean"})


def recent_folds(predictions: DataFrame, folds: DataFrame, n: int = 4, keys: Sequence[str] = (ZONE,)) -> DataFrame:
    """Fold forecasts of the last ``n`` folds of each series."""
    newest = folds.groupBy(*keys).agg(F.max("fold").alias("_newest"))
    return (
        predictions.join(small_side(newest), list(keys))
        .filter(F.col("fold") > F.col("_newest") - n)
        .drop("_newest")
    )


def price_heatmap(
    df: DataFrame, *, price: str = PRICE, ts: str = TS, tz: str = MARKET_TZ, keys: Sequence[str] = (ZONE,)
) -> DataFrame:
    """Mean price by local hour, one column per local month."""
    local = local_time(ts, tz)
    months = [F.avg(F.when(F.month(local) == m, F.col(price))).alias(name) for m, name in enumerate(MONTHS, 1)]
    return df.groupBy(*keys, F.hour(local).alias("hour")).agg(*months)


def recent_comparison(
    scored: DataFrame,
    n: int = 14 * 24,
    *,
    actual: str = "y_true",
    model: str = "y_pred",
    baseline: str = "y_naive",
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
) -> DataFrame:
    """Error of both models over the last ``n`` rows that both forecast."""
    both = scored.filter(F.col(model).isNotNull() & F.col(baseline).isNotNull())
    recent = edge_rows(both, keys, ts, n, last=True)
    return recent.groupBy(*keys).agg(
        F.min(ts).alias("first_hour"),
        F.max(ts).alias("last_hour"),
        F.count(F.lit(1)).alias("n_common"),
        F.avg(F.abs(F.col(actual) - F.col(baseline))).alias("baseline_mae"),
        F.avg(F.abs(F.col(actual) - F.col(model))).alias("model_mae"),
    )


def forecast_summary(forecast: DataFrame, value: str = "y_pred", keys: Sequence[str] = (ZONE,)) -> DataFrame:
    return forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"),
        F.avg(value).alias("mean_forecast"),
        F.min(value).alias("min_forecast"),
        F.max(value).alias("max_forecast"),
    )
