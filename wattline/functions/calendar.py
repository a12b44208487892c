"""Calendar columns in UTC and in market-local time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wattline.config import MARKET_TZ

# National holidays on fixed dates, month-day.
FIXED_HOLIDAYS = ("01-01", "05-01", "10-03", "12-25", "12-26")

PEAK_FIRST_HOUR = 8
PEAK_END_HOUR = 20


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def utc_floor(unit: str, ts: str | Column) -> Column:
    """Start of the UTC hour, day, week (Monday) or month, without a zone."""
    return F.date_trunc(unit, _col(ts)).cast("timestamp_ntz")


def local_time(ts: str | Column, tz: str = MARKET_TZ) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _col(ts))


def day_of_week(local: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(local)


def is_holiday(local: Column, holidays: tuple[str, ...] = FIXED_HOLIDAYS) -> Column:
    return F.date_format(local, "MM-dd").isin(*holidays)


def is_peak(ts: str | Column, tz: str = MARKET_TZ) -> Column:
    """Weekday hours 08–19 in market-local time; holidays count as weekdays."""
    local = local_time(ts, tz)
    hour = F.hour(local)
    return (day_of_week(local) < 5) & (hour >= PEAK_FIRST_HOUR) & (hour < PEAK_END_HOUR)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * F.lit(2.0) * F.pi() / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def delivery_week_end(ts: str | Column) -> Column:
    """The Monday that closes a Tuesday-to-Monday delivery week."""
    day_before = _col(ts) - F.expr("interval 1 day")
    return (F.date_trunc("week", day_before) + F.expr("interval 7 days")).cast("timestamp_ntz")


def delivery_week_label(week_end: Column) -> Column:
    """Year and week-of-year of the closing Monday, weeks counted from the first Monday."""
    week = F.floor((F.dayofyear(week_end) + 6) / 7).cast("string")
    return F.concat(F.year(week_end).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))
