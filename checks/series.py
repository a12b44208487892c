"""Queries for rules in series notation that look at windows, running values, ranks and whole series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import market_sparse, with_views
from checks.registry import query
from wattline.operators import rules
from wattline.operators.rules import Rule

_ORDER = "PARTITION BY zone ORDER BY utc_timestamp"


def _rolling(expression: str, size: int, least: int | None = None, ahead: int = 0) -> str:
    """A window aggregate of ``x`` that is null below ``least`` values."""
    frame = f"OVER ({_ORDER} ROWS BETWEEN {size - 1 - ahead} PRECEDING AND {ahead} FOLLOWING)"
    return f"CASE WHEN count(x) {frame} >= {size if least is None else least} THEN {expression} {frame} END"


def _judged(name: str, column: str, ok: str, **columns: str) -> str:
    """Violations of a rule whose condition reads ``x``, the column's values, and more columns made from them."""
    made = "".join(f", {sql} AS {c}" for c, sql in columns.items())
    return f"""SELECT zone, '{name}' AS name, count(*) FILTER (NOT coalesce({ok}, false)) AS violations,
      round(count(*) FILTER (NOT coalesce({ok}, false)) / count(*), 6) AS fraction
      FROM (SELECT *{made} FROM (SELECT zone, utc_timestamp, {column} AS x,
              row_number() OVER ({_ORDER}) AS row FROM market_sparse WHERE {column} IS NOT NULL) AS values_of)
      GROUP BY 1"""


#: Where a price is below the one before.
_FALLS = f"falls AS (SELECT zone, price_c < lag(price_c) OVER ({_ORDER}) AS falls FROM market_sparse)"


def _query(name: str, *cases: tuple) -> None:
    """Registers the rules of ``cases``: (expression, column, SQL condition, SQL columns)."""
    list_ = [Rule(expression, column, expression) for expression, column, *_ in cases]
    sql = "\nUNION ALL\n".join(
        _judged(expression.replace("'", "''"), column, ok, **(columns[0] if columns else {})) for expression, column, ok, *columns in cases
    )

    @query(name, with_views(sql, "market_sparse", steps=_FALLS))
    def build(spark, sf_dir):
        results = rules.run_rules(market_sparse(spark, sf_dir), list_)
        return results.select("zone", "name", "violations", F.round("fraction", 6).alias("fraction"))


_query(
    "rule_rolling_quantile",
    ("(s - s.rolling(168, min_periods=24).median()).abs() <= 4000", "price_c", "abs(x - m) <= 4000",
     {"m": _rolling("quantile_cont(x, 0.5)", 168, 24)}),
    ("s <= s.rolling(720, min_periods=1).quantile(0.95)", "price_c", "x <= m", {"m": _rolling("quantile_cont(x, 0.95)", 720, 1)}),
    ("s.rolling(25, center=True, min_periods=5).quantile(0.1) < 9000", "load_c", "m < 9000",
     {"m": _rolling("quantile_cont(x, 0.1)", 25, 5, 12)}),
    ("s.rolling(8).median() > s.rolling(24).quantile(0.25)", "wind_offshore_c", "m > q",
     {"m": _rolling("quantile_cont(x, 0.5)", 8), "q": _rolling("quantile_cont(x, 0.25)", 24)}),
)

_UPTO = f"OVER ({_ORDER} ROWS UNBOUNDED PRECEDING)"


def _fading(keep: float, first: str, adjust: bool) -> str:
    """The recurrence as a weighted running sum; powers stay in range for a month of hours."""
    total = f"pow({keep}::double, row) * sum({first} * pow({keep}::double, -row)) {_UPTO}"
    return f"({total}) / ((1 - pow({keep}::double, row)) / (1 - {keep}::double))" if adjust else total


_query(
    "rule_prefix_scan",
    ("s >= s.expanding().mean() * 0.4", "price_c", "x >= m * 0.4", {"m": f"avg(x) {_UPTO}"}),
    ("s > s.cummin() + 100", "load_c", "x > m + 100", {"m": f"min(x) {_UPTO}"}),
    ("s < s.cummax() * 0.9", "wind_onshore_c", "x < m * 0.9", {"m": f"max(x) {_UPTO}"}),
    ("s.cumsum() % 7 != 0", "solar_c", "m % 7 <> 0", {"m": f"sum(x) {_UPTO}"}),
    ("(s - s.ewm(span=24).mean()).abs() <= 4000", "price_c", "abs(x - m) <= 4000", {"m": _fading(1 - 2 / 25, "x", True)}),
    ("s.ewm(alpha=0.2, adjust=False).mean() <= 11000", "price_c", "m <= 11000",
     {"m": _fading(0.8, "x * CASE WHEN row = 1 THEN 1 ELSE 0.2::double END", False)}),
)

_ALL = "OVER (PARTITION BY zone)"
_RANK = "rank() OVER (PARTITION BY zone ORDER BY x) + (count(*) OVER (PARTITION BY zone, x) - 1) / 2.0"
_query(
    "rule_ranks",
    ("s.rank() <= 300.5", "price_c", "m <= 300.5", {"m": _RANK}),
    ("s.rank(pct=True) <= 0.97", "load_c", "m / n <= 0.97", {"m": _RANK, "n": f"count(*) {_ALL}"}),
    ("s.rank(method='dense', ascending=False) > 5", "wind_offshore_c", "m > 5",
     {"m": "dense_rank() OVER (PARTITION BY zone ORDER BY x DESC)"}),
    ("~s.duplicated()", "solar_c", "m = 1", {"m": "row_number() OVER (PARTITION BY zone, x ORDER BY utc_timestamp)"}),
    ("s.is_monotonic_increasing", "price_c", "m = 0",
     {"m": "(SELECT count(*) FROM falls f WHERE f.zone = values_of.zone AND f.falls)"}),
    ("s.nunique() > 200", "load_c", "m > 200", {"m": f"count(DISTINCT x) {_ALL}"}),
)

_query(
    "rule_scalars_series",
    ("s.mean() > 0", "price_c", "m > 0", {"m": f"avg(x) {_ALL}"}),
    ("(s - s.mean()).abs() <= 2 * s.std()", "price_c", "abs(x - m) <= 2 * d", {"m": f"avg(x) {_ALL}", "d": f"stddev_samp(x) {_ALL}"}),
    ("s.quantile(0.99) < 30000", "load_c", "m < 30000", {"m": f"quantile_cont(x, 0.99) {_ALL}"}),
    ("(s > 1000).mean() >= 0.99", "wind_onshore_c", "m >= 0.99", {"m": f"avg((x > 1000)::int) {_ALL}"}),
    ("s <= s.quantile(0.75) + 1.5 * (s.quantile(0.75) - s.quantile(0.25))", "load_c", "x <= c + 1.5 * (c - a)",
     {"a": f"quantile_cont(x, 0.25) {_ALL}", "c": f"quantile_cont(x, 0.75) {_ALL}"}),
    ("s.pct_change().abs() < 0.8", "price_c", "abs(x / m - 1) < 0.8", {"m": f"lag(x) OVER ({_ORDER})"}),
    ("s.shift(-1) - s <= 6000", "price_c", "m - x <= 6000", {"m": f"lead(x) OVER ({_ORDER})"}),
    ("s % 50 != 7", "price_c", "x % 50 <> 7"),
    ("1000 / (s - 5000) < 2", "price_c", "x = 5000 AND false OR 1000 / nullif(x - 5000, 0) < 2"),
    ("s ** 2 <= 1e8", "price_c", "x * x <= 1e8"),
    ("s.isna() == False", "load_c", "x IS NOT NULL"),
    ("(s / 100).round().clip(upper=120) < 120", "price_c", "least(round_even(x / 100, 0), 120) < 120"),
)
