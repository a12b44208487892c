from dataclasses import replace

from pyspark.sql import functions as F

from checks.fixtures import ENERGY, local_sql, market_dense, market_sparse, with_views
from checks.registry import query
from wattline.operators import cleaning, features, leakage

LIMITS = (1000.0, 15000.0)
FILLED = tuple(ENERGY)
SPEC = features.FeatureSpec(
    price="price_c", fundamentals=FILLED, wind=("wind_onshore_c", "wind_offshore_c"), solar="solar_c"
)
_W = "OVER (PARTITION BY zone ORDER BY utc_timestamp"


def _full(agg: str, c: str, n: int, shift: int = 24) -> str:
    frame = f"{_W} ROWS BETWEEN {n + shift - 1} PRECEDING AND {shift} PRECEDING)"
    return f"CASE WHEN count({c}) {frame} = {n} THEN {agg}({c}) {frame} END"


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) {_W})"


PRICE_SQL = {
    **{f"price_lag_{k}h": _lag("price_c", k) for k in (24, 48, 72, 168, 336)},
    "price_roll_24h_mean": f"round({_full('avg', 'price_c', 24)}, 6)",
    "price_roll_168h_mean": f"round({_full('avg', 'price_c', 168)}, 6)",
    "price_roll_168h_std": f"round({_full('stddev_samp', 'price_c', 168)}, 6)",
    "price_roll_24h_max": _full("max", "price_c", 24),
    "price_roll_24h_min": _full("min", "price_c", 24),
}
FUNDAMENTAL_SQL = {
    name: expr
    for c in FILLED
    for name, expr in (
        (f"{c}_lag24", _lag(c, 24)),
        (f"{c}_lag168", _lag(c, 168)),
        (f"{c}_roll24_mean", f"round({_full('avg', c, 24)}, 6)"),
    )
}
_WIND = "(coalesce(wind_onshore_c, 0) + coalesce(wind_offshore_c, 0))"
RENEWABLES_SQL = {
    "wind_total_lag24": _lag(_WIND, 24),
    "wind_total_lag168": _lag(_WIND, 168),
    "renewables_total_lag24": _lag(f"(solar_c + {_WIND})", 24),
}
_L = local_sql("utc_timestamp")
CALENDAR_SQL = {
    "hour": f"cast(hour({_L}) AS int)",
    "dow": f"cast(isodow({_L}) - 1 AS int)",
    "month": f"cast(month({_L}) AS int)",
    "week_of_year": f"cast(weekofyear({_L}) AS int)",
    "is_weekend": f"cast(isodow({_L}) >= 6 AS int)",
}
HOLIDAY_SQL = {"is_holiday": f"cast(strftime({_L}, '%m-%d') IN ('01-01', '05-01', '10-03', '12-25', '12-26') AS int)"}
CYCLIC_SQL = {
    f"{name}_{fn}": f"round({fn}(({value}) * 2.0 * pi() / {period}.0), 6) + 0.0::double"
    for name, value, period in (
        ("hour", f"hour({_L})", 24), ("dow", f"isodow({_L}) - 1", 7), ("month", f"month({_L})", 12))
    for fn in ("sin", "cos")
}
_ROUNDED = [c for c, e in {**PRICE_SQL, **FUNDAMENTAL_SQL, **CYCLIC_SQL}.items() if e.startswith("round")]


def _select(columns: dict[str, str], source: str) -> str:
    listed = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT zone, utc_timestamp, {listed} FROM {source}"


def _shown(df, columns):
    rounded = [(F.round(c, 6) if c in _ROUNDED else F.col(c)).alias(c) for c in columns]
    return df.select("zone", "utc_timestamp", *rounded)


@query("clean_price_range", with_views(
    "SELECT zone, utc_timestamp, price_c FROM market_sparse WHERE price_c BETWEEN 1000 AND 15000", "market_sparse"))
def clean_price_range(spark, sf_dir):
    kept = cleaning.keep_price_range(market_sparse(spark, sf_dir), *LIMITS, price="price_c")
    return kept.select("zone", "utc_timestamp", "price_c")


@query("sparse_columns", with_views(
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, round((count(*) - count({c})) / count(*), 6) AS missing_fraction,
        (count(*) - count({c})) / count(*) > 0.47 AS dropped FROM kept""" for c in FILLED),
    "market_sparse", steps="kept AS (SELECT * FROM market_sparse WHERE price_c BETWEEN 1000 AND 15000)"))
def sparse_columns(spark, sf_dir):
    kept = cleaning.keep_price_range(market_sparse(spark, sf_dir), *LIMITS, price="price_c")
    report = cleaning.sparse_columns(kept, FILLED, limit=0.47)
    return report.withColumn("missing_fraction", F.round("missing_fraction", 6)).drop("reason")


def _fill(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) {_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query("ffill_limit", with_views(_select({c: _fill(c) for c in FILLED}, "market_sparse"), "market_sparse"))
def ffill_limit(spark, sf_dir):
    filled = cleaning.forward_fill(market_sparse(spark, sf_dir), FILLED)
    return filled.select("zone", "utc_timestamp", *FILLED)


@query("complete_cases", with_views(
    "SELECT * FROM market_sparse WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ("price_c", *FILLED)),
    "market_sparse"))
def complete_cases(spark, sf_dir):
    return cleaning.complete_cases(market_sparse(spark, sf_dir), ["price_c", *FILLED])


@query("calendar_features", with_views(_select(CALENDAR_SQL, "market_sparse"), "market_sparse"))
def calendar_features(spark, sf_dir):
    return _shown(features.calendar_features(market_sparse(spark, sf_dir)), CALENDAR_SQL)


@query("holiday_flag", with_views(_select(HOLIDAY_SQL, "daily_series"), "daily_series"))
def holiday_flag(spark, sf_dir):
    from checks.fixtures import daily_series

    return _shown(features.calendar_features(daily_series(spark, sf_dir)), HOLIDAY_SQL)


@query("cyclic_features", with_views(_select(CYCLIC_SQL, "market_sparse"), "market_sparse"))
def cyclic_features(spark, sf_dir):
    return _shown(features.calendar_features(market_sparse(spark, sf_dir)), CYCLIC_SQL)


def _laid(spark, sf_dir):
    return features.lay_out(market_sparse(spark, sf_dir), SPEC)


_LAGS = {c: e for c, e in PRICE_SQL.items() if "lag" in c}
_ROLLS = {c: e for c, e in PRICE_SQL.items() if "roll" in c}


@query("price_lags", with_views(_select(_LAGS, "market_sparse"), "market_sparse"))
def price_lags(spark, sf_dir):
    return _shown(features.price_features(_laid(spark, sf_dir), SPEC).own_rows(), _LAGS)


@query("price_rolling", with_views(_select(_ROLLS, "market_sparse"), "market_sparse"))
def price_rolling(spark, sf_dir):
    return _shown(features.price_features(_laid(spark, sf_dir), SPEC).own_rows(), _ROLLS)


@query("fundamental_features", with_views(_select(FUNDAMENTAL_SQL, "market_sparse"), "market_sparse"))
def fundamental_features(spark, sf_dir):
    return _shown(features.fundamental_features(_laid(spark, sf_dir), SPEC).own_rows(), FUNDAMENTAL_SQL)


@query("renewables_features", with_views(_select(RENEWABLES_SQL, "market_sparse"), "market_sparse"))
def renewables_features(spark, sf_dir):
    return _shown(features.renewables_features(_laid(spark, sf_dir), SPEC).own_rows(), RENEWABLES_SQL)


_MATRIX = {**CALENDAR_SQL, **HOLIDAY_SQL, **CYCLIC_SQL, **PRICE_SQL, **FUNDAMENTAL_SQL, **RENEWABLES_SQL}


def _matrix_sql(source: str, keep: str = "") -> str:
    inputs = {"price_c": "price_c", **_MATRIX}
    return f"SELECT * FROM ({_select(inputs, source)}) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in inputs)


_FILLED_STEP = """filled AS (
  SELECT zone, utc_timestamp, price_c, {fills} FROM {source} WHERE price_c BETWEEN {lo} AND {hi})"""


def _filled(source, lo, hi):
    return _FILLED_STEP.format(
        fills=", ".join(f"{_fill(c)} AS {c}" for c in FILLED), source=source, lo=lo, hi=hi)


@query("feature_matrix", with_views(_matrix_sql("filled"), "market_dense", steps=_filled("market_dense", -50000, 300000)))
def feature_matrix(spark, sf_dir):
    kept = cleaning.keep_price_range(market_dense(spark, sf_dir), -50000.0, 300000.0, price="price_c")
    return _shown(features.feature_matrix(kept, SPEC), ["price_c", *_MATRIX])


@query("feature_matrix_time_lags", with_views(
    f"""SELECT a.zone, a.utc_timestamp, a.price_c, {", ".join(f"l{k}.price_c AS price_lag_{k}h" for k in (24, 48, 72, 168, 336))}
    FROM market_sparse a """ + " ".join(
        f"LEFT JOIN market_sparse l{k} ON l{k}.zone = a.zone AND l{k}.utc_timestamp = a.utc_timestamp - interval {k} hour"
        for k in (24, 48, 72, 168, 336)), "market_sparse"))
def feature_matrix_time_lags(spark, sf_dir):
    """Lags by exact hours instead of rows, on a grid with gaps."""
    laid = features.lay_out(market_sparse(spark, sf_dir), SPEC, lag_mode="time")
    return _shown(features.price_features(laid, SPEC).own_rows(), ["price_c", *_LAGS])


_PAIRS = ((24, 100), (5, 7))
_PAIR_SQL = {
    name: expr
    for short, long in _PAIRS
    for name, expr in (
        (f"price_roll_{short}h_max", _full("max", "price_c", short)),
        (f"price_roll_{short}h_min", _full("min", "price_c", short)),
        (f"price_roll_{short}h_mean", f"round({_full('avg', 'price_c', short)}, 6)"),
        (f"price_roll_{long}h_mean", f"round({_full('avg', 'price_c', long)}, 6)"),
        (f"price_roll_{long}h_std", f"round({_full('stddev_samp', 'price_c', long)}, 6)"),
    )
}


@query("price_rolling_windows", with_views(_select(_PAIR_SQL, "market_sparse"), "market_sparse"))
def price_rolling_windows(spark, sf_dir):
    """Windows that are no multiples of each other."""
    laid = features.lay_out(market_sparse(spark, sf_dir), replace(SPEC, long_window=max(map(max, _PAIRS))))
    for short, long in _PAIRS:
        laid = features.price_features(laid, replace(SPEC, lags=(), short_window=short, long_window=long))
    rounded = [(F.round(c, 6) if e.startswith("round") else F.col(c)).alias(c) for c, e in _PAIR_SQL.items()]
    return laid.own_rows().select("zone", "utc_timestamp", *rounded)


def _gaps(columns: dict[str, str]) -> str:
    """Least distance in hours between a row and the newest hour behind each column."""
    listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    cells = "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n_rows, min(h - {c}) AS least_gap_steps,
        count(*) FILTER (h - {c} < 24) AS n_leaks FROM traced""" for c in columns)
    return f"traced AS (SELECT h, {listed} FROM filled),\ngaps AS ({cells})"


_TIMES = f"""times AS (SELECT zone, utc_timestamp, epoch(utc_timestamp) / 3600 AS h,
  {", ".join(f"CASE WHEN {c} IS NOT NULL THEN epoch(utc_timestamp) / 3600 END AS {c}" for c in ("price_c", *FILLED))} FROM market_sparse),
filled AS (SELECT zone, utc_timestamp, h, price_c, {", ".join(f"{_fill(c)} AS {c}" for c in FILLED)} FROM times)"""
_NEWEST_WIND = "greatest(wind_onshore_c, wind_offshore_c)"
_TRACED = {
    **{c: e for c, e in PRICE_SQL.items() if "lag" in c},
    **{f"price_roll_24h_{a}": _full("max", "price_c", 24) for a in ("mean", "max", "min")},
    **{f"price_roll_168h_{a}": _full("max", "price_c", 168) for a in ("mean", "std")},
    **{c: e if "lag" in c else _full("max", c.removesuffix("_roll24_mean"), 24) for c, e in FUNDAMENTAL_SQL.items()},
    "wind_total_lag24": _lag(_NEWEST_WIND, 24),
    "wind_total_lag168": _lag(_NEWEST_WIND, 168),
    "renewables_total_lag24": _lag(f"CASE WHEN solar_c IS NOT NULL THEN greatest(solar_c, {_NEWEST_WIND}) END", 24),
}


@query("leakage_report", with_views("SELECT * FROM gaps", "market_sparse", steps=f"{_TIMES},\n{_gaps(_TRACED)}"))
def leakage_report(spark, sf_dir):
    """Newest hour behind every feature of the matrix, through filling, lags, windows and sums."""
    return leakage.leakage_report(market_sparse(spark, sf_dir), SPEC)
