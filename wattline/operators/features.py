"""Leakage-safe features: calendar fields, lags and shifted rolling statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wattline.config import FUNDAMENTALS, HOUR_MICROS, MARKET_TZ, PRICE, SOLAR, TS, WIND, ZONE
from wattline.functions.calendar import cyclic, day_of_week, is_holiday, local_time
from wattline.functions.numbers import row_sum
from wattline.operators.cleaning import FILL_LIMIT, complete_cases, fill_columns
from wattline.plans.blocks import BLOCK_STEPS, BlockedSeries, block_series

CALENDAR = (
    "hour", "dow", "month", "week_of_year", "is_weekend", "is_holiday",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
)


@dataclass(frozen=True)
class FeatureSpec:
    """Column names and look-back lengths, in steps of the series.

    The defaults are the day-ahead set for hourly data: nothing newer than 24
    steps enters a feature.
    """

    price: str = PRICE
    fundamentals: tuple[str, ...] = FUNDAMENTALS
    wind: tuple[str, ...] = WIND
    solar: str = SOLAR
    unit: str = "h"
    price_prefix: str = "price"
    lags: tuple[int, ...] = (24, 48, 72, 168, 336)
    min_lag: int = 24
    short_window: int = 24
    long_window: int = 168
    fundamental_lags: tuple[int, int] = (24, 168)
    fill_limit: int = FILL_LIMIT
    step_micros: int = HOUR_MICROS

    def present(self, df: DataFrame) -> list[str]:
        return [c for c in self.fundamentals if c in df.columns]

    def look_back(self) -> int:
        rolling = self.min_lag + max(self.short_window, self.long_window) - 1
        fundamental = max(*self.fundamental_lags, self.min_lag + self.short_window - 1) + self.fill_limit
        return max(*self.lags, rolling, fundamental)


def calendar_features(df: DataFrame, *, ts: str = TS, tz: str = MARKET_TZ) -> DataFrame:
    local = local_time(ts, tz)
    fields = {
        "hour": F.hour(local),
        "dow": day_of_week(local),
        "month": F.month(local),
        "week_of_year": F.weekofyear(local),
        "is_weekend": (day_of_week(local) >= 5).cast("int"),
        "is_holiday": is_holiday(local).cast("int"),
    }
    for name, period in (("hour", 24), ("dow", 7), ("month", 12)):
        fields[f"{name}_sin"], fields[f"{name}_cos"] = cyclic(fields[name], period)
    return df.withColumns(fields)


def lay_out(
    df: DataFrame,
    spec: FeatureSpec,
    *,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    lag_mode: str = "row",
    block_steps: int = BLOCK_STEPS,
) -> BlockedSeries:
    return block_series(
        df, keys, ts, look_back=spec.look_back(), mode=lag_mode, step_micros=spec.step_micros, block_steps=block_steps
    )


def price_features(laid: BlockedSeries, spec: FeatureSpec) -> BlockedSeries:
    """Lags of the price, and rolling statistics of any two windows that end ``min_lag`` steps back."""
    p, name, unit = spec.price, spec.price_prefix, spec.unit
    short, long, shift = spec.short_window, spec.long_window, spec.min_lag
    laid = laid.with_columns({f"{name}_lag_{k}{unit}": laid.lag(p, k) for k in spec.lags})
    return laid.whole_windows(
        p,
        {
            f"{name}_roll_{short}{unit}_max": ("max", short, shift),
            f"{name}_roll_{short}{unit}_min": ("min", short, shift),
            f"{name}_roll_{short}{unit}_mean": ("mean", short, shift),
            f"{name}_roll_{long}{unit}_mean": ("mean", long, shift),
            f"{name}_roll_{long}{unit}_std": ("std", long, shift),
        },
    )


def fundamental_features(laid: BlockedSeries, spec: FeatureSpec) -> BlockedSeries:
    near, far = spec.fundamental_lags
    columns = {}
    for c in spec.present(laid.df):
        columns[f"{c}_lag{near}"] = laid.lag(c, near)
        columns[f"{c}_lag{far}"] = laid.lag(c, far)
        columns[f"{c}_roll{spec.short_window}_mean"] = laid.full(F.avg(c), c, spec.short_window, spec.min_lag)
    return laid.with_columns(columns) if columns else laid


def renewables_features(laid: BlockedSeries, spec: FeatureSpec) -> BlockedSeries:
    """Wind total counts an absent turbine type as 0; renewables need solar."""
    near, far = spec.fundamental_lags
    wind = [c for c in spec.wind if c in laid.df.columns]
    if not wind:
        return laid
    totals = {"wind_total_mwh": laid.joint(row_sum(*wind), *wind)}
    if spec.solar in laid.df.columns:
        totals["_renewables"] = laid.joint(F.col(spec.solar) + row_sum(*wind), spec.solar, *wind)
    laid = laid.with_columns(totals)
    columns = {f"wind_total_lag{k}": laid.lag("wind_total_mwh", k) for k in (near, far)}
    if "_renewables" in totals:
        columns[f"renewables_total_lag{near}"] = laid.lag("_renewables", near)
    done = laid.with_columns(columns)
    return done.drop("_renewables")


def feature_columns(columns: Sequence[str], spec: FeatureSpec, keys: Sequence[str] = (ZONE,), ts: str = TS) -> list[str]:
    """Model inputs: everything but keys, target and same-hour fundamentals."""
    raw = {*keys, ts, spec.price, "wind_total_mwh", *spec.fundamentals}
    return [c for c in columns if c not in raw]


def neighbour_features(laid: BlockedSeries, spec: FeatureSpec, *, fill: bool = True) -> BlockedSeries:
    """All features that read other rows, after filling."""
    present = spec.present(laid.df)
    if fill and present:
        laid = fill_columns(laid, present, spec.fill_limit)
    return renewables_features(fundamental_features(price_features(laid, spec), spec), spec)


def feature_matrix(
    df: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    *,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    tz: str = MARKET_TZ,
    lag_mode: str = "row",
    block_steps: int = BLOCK_STEPS,
    fill: bool = True,
) -> DataFrame:
    """Keys, target and features of all complete rows.

    Filling, lags and rolling statistics use one block layout: one shuffle and
    one sort of the wide rows (two shuffles with row positions).
    """
    present = spec.present(df)
    laid = lay_out(df.select(*keys, ts, spec.price, *present), spec, ts=ts, keys=keys, lag_mode=lag_mode, block_steps=block_steps)
    return matrix_of(laid, spec, ts=ts, tz=tz, fill=fill)


def matrix_of(
    laid: BlockedSeries, spec: FeatureSpec = FeatureSpec(), *, ts: str = TS, tz: str = MARKET_TZ, fill: bool = True
) -> DataFrame:
    """As :func:`feature_matrix`, from rows that are laid out in blocks."""
    keys = laid.keys
    # Calendar fields need no neighbours, so they are added to surviving rows only.
    neighbours = neighbour_features(laid, spec, fill=fill).own_rows()
    inputs = feature_columns(neighbours.columns, spec, keys, ts)
    complete = complete_cases(neighbours.select(*keys, ts, spec.price, *inputs), [spec.price, *inputs])
    dated = calendar_features(complete, ts=ts, tz=tz)
    return dated.select(*keys, ts, spec.price, *CALENDAR, *inputs)
