from pyspark.sql import functions as F

from checks.fixtures import BOUNDS_C, COLUMNS, market_dense, market_sparse, points_long, with_views
from checks.registry import query
from wattline.operators import quality, rules
from wattline.operators.quality_state import quality_state, tables_from_state, updated
from wattline.operators.rules import Rule
from wattline.session import settle
from wattline.sources.tables import report_json


def _per_column(body: str) -> str:
    """UNION ALL of ``body`` with each column's name and bounds filled in."""
    return "\nUNION ALL\n".join(
        body.format(c=c, lo=BOUNDS_C[c][0], hi=BOUNDS_C[c][1], limit=f"{BOUNDS_C[c][1]}") for c in COLUMNS
    )


def _market(spark, sf_dir):
    """Stored first, where several checks read it."""
    return settle(spark, market_sparse(spark, sf_dir), "market-sparse")


def _stats(spark, sf_dir):
    return quality.column_stats(market_sparse(spark, sf_dir), COLUMNS, bounds=BOUNDS_C)


def _hour_points(spark, sf_dir):
    hour = F.date_trunc("hour", "utc_timestamp").cast("timestamp_ntz")
    return points_long(spark, sf_dir).select("zone", hour.alias("utc_timestamp"))


_EXPECTED = "cast(date_diff('hour', min(utc_timestamp), max(utc_timestamp)) + 1 AS bigint)"


@query("qa_overview", with_views(
    f"""SELECT zone, count(*) AS n_rows, min(utc_timestamp) AS start, max(utc_timestamp) AS "end",
      5::bigint AS n_cols, '{",".join(COLUMNS)}' AS columns, {_EXPECTED} AS expected_hourly_rows
    FROM market_sparse GROUP BY 1""", "market_sparse"))
def qa_overview(spark, sf_dir):
    return quality.overview(market_sparse(spark, sf_dir), COLUMNS)


@query("qa_missing", with_views(_per_column(
    """SELECT zone, '{c}' AS "column", count(*) - count({c}) AS missing_count,
      round((count(*) - count({c})) / count(*), 6) AS missing_fraction FROM market_sparse GROUP BY 1"""),
    "market_sparse"))
def qa_missing(spark, sf_dir):
    missing = quality.missing(_stats(spark, sf_dir))
    return missing.withColumn("missing_fraction", F.round("missing_fraction", 6))


@query("qa_duplicates", with_views(
    """SELECT zone, count(*) - count(DISTINCT date_trunc('hour', utc_timestamp)) AS duplicate_count
    FROM points_long GROUP BY 1""", "points_long"))
def qa_duplicates(spark, sf_dir):
    return quality.duplicate_counts(_hour_points(spark, sf_dir))


@query("qa_duplicate_examples", with_views(
    """SELECT zone, example_no, utc_timestamp FROM (
      SELECT zone, h AS utc_timestamp, row_number() OVER (PARTITION BY zone ORDER BY h) AS example_no
      FROM (SELECT zone, date_trunc('hour', utc_timestamp) AS h,
              row_number() OVER (PARTITION BY zone, date_trunc('hour', utc_timestamp) ORDER BY event_id) AS rn
            FROM points_long) WHERE rn > 1) WHERE example_no <= 5""", "points_long"))
def qa_duplicate_examples(spark, sf_dir):
    return quality.duplicate_examples(_hour_points(spark, sf_dir))


_GAPS = """
grid AS (
  SELECT zone, unnest(generate_series(min(utc_timestamp), max(utc_timestamp), interval 1 hour)) AS utc_timestamp
  FROM market_sparse GROUP BY 1),
gaps AS (SELECT g.* FROM grid g ANTI JOIN market_sparse m USING (zone, utc_timestamp))"""


@query("qa_gaps", with_views(
    """SELECT z.zone, count(g.zone) AS gap_count FROM (SELECT DISTINCT zone FROM market_sparse) z
    LEFT JOIN gaps g ON g.zone = z.zone GROUP BY 1""", "market_sparse", steps=_GAPS))
def qa_gaps(spark, sf_dir):
    return quality.gap_counts(market_sparse(spark, sf_dir))


@query("qa_gap_hours", with_views("SELECT zone, utc_timestamp FROM gaps", "market_sparse", steps=_GAPS))
def qa_gap_hours(spark, sf_dir):
    return quality.gap_hours(market_sparse(spark, sf_dir))


@query("qa_gap_examples", with_views(
    """SELECT * FROM (SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY utc_timestamp) AS example_no,
      utc_timestamp FROM gaps) WHERE example_no <= 5""", "market_sparse", steps=_GAPS))
def qa_gap_examples(spark, sf_dir):
    return quality.gap_examples(market_sparse(spark, sf_dir))


@query("qa_bounds", with_views(_per_column(
    """SELECT zone, '{c}' AS "column", {lo}::double AS lower_bound, {hi}::double AS upper_bound,
      count(*) FILTER ({c} < {lo}) AS below_count, count(*) FILTER ({c} > {hi}) AS above_count
    FROM market_sparse GROUP BY 1"""), "market_sparse"))
def qa_bounds(spark, sf_dir):
    return quality.bound_violations(_stats(spark, sf_dir))


_RANGES = _per_column(
    """SELECT zone, '{c}' AS "column", min({c}) AS "min", max({c}) AS "max",
      round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.99), 6) AS p99
    FROM market_sparse GROUP BY 1""")


def _ranges(market):
    ranges = quality.range_stats(market, COLUMNS)
    return ranges.withColumns({c: F.round(c, 6) for c in ("p01", "p99")})


@query("qa_range_stats", with_views(_RANGES, "market_sparse"))
def qa_range_stats(spark, sf_dir):
    return _ranges(_market(spark, sf_dir))


@query("qa_monthly_coverage", with_views(
    _per_column(
        """SELECT zone, cast(last_day(utc_timestamp) AS varchar) AS month_end, '{c}' AS "column",
          round(count({c}) / count(*), 6) AS coverage FROM market_sparse GROUP BY 1, 2""")
    + """
    UNION ALL
    SELECT zone, cast(last_day(utc_timestamp) AS varchar) AS month_end, 'y_c' AS "column", round(count(y_c) / count(*), 6) AS coverage
    FROM daily_series GROUP BY 1, 2""",
    "market_sparse", "daily_series"))
def qa_monthly_coverage(spark, sf_dir):
    from checks.fixtures import daily_series

    hourly = quality.monthly_coverage(market_sparse(spark, sf_dir), COLUMNS)
    both = hourly.unionByName(quality.monthly_coverage(daily_series(spark, sf_dir), ["y_c"]))
    return both.withColumn("coverage", F.round("coverage", 6))


_ISSUES = f"""
{_GAPS.strip()},
missing AS ({_per_column('''SELECT zone, 'missing' AS kind, '{c}' AS "column",
    round((count(*) - count({c})) / count(*), 4) AS magnitude FROM market_sparse GROUP BY 1''')}),
outside AS ({_per_column('''SELECT zone, 'bounds' AS kind, '{c}' AS "column",
    count(*) FILTER ({c} < {lo} OR {c} > {hi})::double AS magnitude FROM market_sparse GROUP BY 1''')}),
holes AS (SELECT zone, 'gaps' AS kind, 'utc_timestamp' AS "column", count(*)::double AS magnitude FROM gaps GROUP BY 1),
issues AS (
  SELECT * FROM missing WHERE magnitude > 0.05 UNION ALL SELECT * FROM outside WHERE magnitude > 0
  UNION ALL SELECT * FROM holes WHERE magnitude > 24)"""


def _checks(market):
    return quality.judge(quality.column_stats(market, COLUMNS, bounds=BOUNDS_C), quality.timestamp_stats(market))


@query("qa_issues", with_views('SELECT zone, kind, "column", magnitude FROM issues', "market_sparse", steps=_ISSUES))
def qa_issues(spark, sf_dir):
    return quality.issues(_checks(_market(spark, sf_dir))).drop("message")


@query("qa_verdict", with_views(
    """SELECT z.zone, count(i.zone) AS n_issues, count(i.zone) = 0 AS passed
    FROM (SELECT DISTINCT zone FROM market_sparse) z LEFT JOIN issues i ON i.zone = z.zone GROUP BY 1""",
    "market_sparse", steps=_ISSUES))
def qa_verdict(spark, sf_dir):
    return quality.verdict(_checks(_market(spark, sf_dir)))


@query("column_profile", with_views(_per_column(
    """SELECT zone, '{c}' AS "column", 'double' AS dtype, count({c}) AS non_null, min({c}) AS "min", max({c}) AS "max",
      round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM market_sparse GROUP BY 1"""),
    "market_sparse"))
def column_profile(spark, sf_dir):
    return quality.profile(_stats(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("qa_column_report", with_views(_per_column(
    """SELECT zone, '{c}' AS "column", round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct,
      count(*) FILTER ({c} < {lo}) AS below_count, count(*) FILTER ({c} > {hi}) AS above_count,
      min({c}) AS "min", max({c}) AS "max",
      round(quantile_cont({c}, 0.01), 6) AS p01, round(quantile_cont({c}, 0.99), 6) AS p99
    FROM market_sparse GROUP BY 1"""), "market_sparse"))
def qa_column_report(spark, sf_dir):
    market = _market(spark, sf_dir)
    report = quality.column_report(quality.column_stats(market, COLUMNS, bounds=BOUNDS_C), _ranges(market))
    return report.withColumn("missing_pct", F.round("missing_pct", 6))


# Rules -----------------------------------------------------------------------

ROW_RULES = (
    Rule("price_low", "price_c", "s >= 500"),
    Rule("price_high", "price_c", "s <= 20000", severity="error"),
    Rule("load_bounds", "load_c", "s between 100 and 30000"),
    Rule("solar_positive", "solar_c", "s > 0", severity="error"),
)
ROW_SQL = {
    "price_low": "price_c >= 500",
    "price_high": "price_c <= 20000",
    "load_bounds": "load_c BETWEEN 100 AND 30000",
    "solar_positive": "solar_c > 0",
}
JUMP_RULES = (Rule("price_jump", "price_c", "jump(6000)"), Rule("load_jump", "load_c", "jump(9000)"))
FLAT_RULES = (Rule("offshore_flat", "wind_offshore_c", "flatline(24)"), Rule("load_flat", "load_c", "flatline(12)"))
SPIKE_RULES = (Rule("price_spike", "price_c", "spike(12000, 168, 1)"),)
TIME_RULES = (Rule("on_the_hour", "index", "minute(s) = 0 and second(s) = 0"),)
ODD_RULES = (
    Rule("absent_column", "gas_c", "s > 0"),
    Rule("broken_text", "price_c", "s >"),
    Rule("other_column", "price_c", "load_c > 0"),
    Rule("unknown_function", "price_c", "frobnicate(s) > 0"),
    Rule("mean_positive", "price_c", "avg(s) > 0"),
    Rule("mean_huge", "load_c", "avg(s) > 1000000"),
)
ALL_RULES = (*ROW_RULES, *JUMP_RULES, *FLAT_RULES, *SPIKE_RULES, *TIME_RULES, *ODD_RULES)


def _counted(name: str, column: str, ok: str, source: str = "market_sparse") -> str:
    return f"""SELECT zone, '{name}' AS name, count(*) FILTER (NOT coalesce({ok}, false)) AS violations,
      round(count(*) FILTER (NOT coalesce({ok}, false)) / greatest(count(*), 1), 6) AS fraction
      FROM {source} WHERE {column} IS NOT NULL GROUP BY 1"""


def _row_sql(r):
    return _counted(r.name, r.column, ROW_SQL[r.name])


def _jump_sql(r, k):
    source = f"""(SELECT zone, {r.column}, {r.column} - lag({r.column}) OVER (PARTITION BY zone ORDER BY utc_timestamp) AS d
      FROM market_sparse WHERE {r.column} IS NOT NULL)"""
    return _counted(r.name, r.column, f"abs(d) <= {k}", source)


def _flat_sql(r, n):
    source = f"""(SELECT zone, {r.column}, stddev_samp({r.column}) OVER (PARTITION BY zone ORDER BY utc_timestamp
      ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS d FROM market_sparse WHERE {r.column} IS NOT NULL)"""
    return _counted(r.name, r.column, "d > 0", source)


def _spike_sql(r, t, n, m):
    source = f"""(SELECT zone, {r.column}, count(*) FILTER ({r.column} > {t}) OVER (PARTITION BY zone
      ORDER BY utc_timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS d
      FROM market_sparse WHERE {r.column} IS NOT NULL)"""
    return _counted(r.name, r.column, f"{r.column} <= {t} OR d <= {m}", source)


def _time_sql(r):
    return _counted(r.name, "utc_timestamp", "minute(utc_timestamp) = 0 AND second(utc_timestamp) = 0")


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _violations(spark, sf_dir, rule_list):
    results = rules.run_rules(market_sparse(spark, sf_dir), rule_list)
    return results.select("zone", "name", "violations", F.round("fraction", 6).alias("fraction"))


@query("rule_bounds", with_views(_union(map(_row_sql, ROW_RULES)), "market_sparse"))
def rule_bounds(spark, sf_dir):
    return _violations(spark, sf_dir, ROW_RULES)


_JUMPS = [_jump_sql(JUMP_RULES[0], 6000), _jump_sql(JUMP_RULES[1], 9000)]
_FLATS = [_flat_sql(FLAT_RULES[0], 24), _flat_sql(FLAT_RULES[1], 12)]
_SPIKES = [_spike_sql(SPIKE_RULES[0], 12000, 168, 1)]


@query("rule_jump", with_views(_union(_JUMPS), "market_sparse"))
def rule_jump(spark, sf_dir):
    return _violations(spark, sf_dir, JUMP_RULES)


@query("rule_flatline", with_views(_union(_FLATS), "market_sparse"))
def rule_flatline(spark, sf_dir):
    return _violations(spark, sf_dir, FLAT_RULES)


@query("rule_spike_count", with_views(_union(_SPIKES), "market_sparse"))
def rule_spike_count(spark, sf_dir):
    return _violations(spark, sf_dir, SPIKE_RULES)


# Rules as language models write them, in series notation.
SERIES_RULES = (
    Rule("price_non_negative", "price_c", "s >= -50"),
    Rule("price_reasonable_upper_bound", "price_c", "s <= 500"),
    Rule("load_positive", "load_c", "s > 0"),
    Rule("load_realistic_bounds", "load_c", "(s >= 30000) & (s <= 80000)"),
    Rule("wind_offshore_non_negative", "wind_offshore_c", "s >= 0"),
    Rule("wind_offshore_capacity_bound", "wind_offshore_c", "s <= 10000"),
    Rule("price_hourly_jump_limit", "price_c", "s.diff().abs() <= 150"),
    Rule("load_hourly_jump_limit", "load_c", "s.diff().abs() <= 5000"),
    Rule("wind_offshore_hourly_jump_limit", "wind_offshore_c", "s.diff().abs() <= 2000"),
    Rule("price_not_extreme_spike", "price_c",
         "(s <= 400) | (s.rolling(window=168, min_periods=1).apply(lambda x: (x > 400).sum()) <= 1)"),
    Rule("wind_offshore_not_constant", "wind_offshore_c", "s.rolling(window=24, min_periods=1).std() > 0"),
    Rule("load_not_constant", "load_c", "s.rolling(window=12, min_periods=1).std() > 0"),
)
_SERIES_OK = {0: "price_c >= -50", 1: "price_c <= 500", 2: "load_c > 0", 3: "load_c BETWEEN 30000 AND 80000",
              4: "wind_offshore_c >= 0", 5: "wind_offshore_c <= 10000"}
_SERIES_SQL = _union([
    *[_counted(SERIES_RULES[i].name, SERIES_RULES[i].column, ok) for i, ok in _SERIES_OK.items()],
    *[_jump_sql(SERIES_RULES[i], k) for i, k in ((6, 150), (7, 5000), (8, 2000))],
    _spike_sql(SERIES_RULES[9], 400, 168, 1),
    _flat_sql(SERIES_RULES[10], 24), _flat_sql(SERIES_RULES[11], 12),
])


@query("series_rules", with_views(
    f"SELECT *, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({_SERIES_SQL})", "market_sparse"))
def series_rules(spark, sf_dir):
    results = rules.run_rules(market_sparse(spark, sf_dir), SERIES_RULES)
    return results.select("zone", "name", "violations", F.round("fraction", 6).alias("fraction"), "status")


@query("rule_timestamp", with_views(_time_sql(TIME_RULES[0]), "market_sparse"))
def rule_timestamp(spark, sf_dir):
    return _violations(spark, sf_dir, TIME_RULES)


def _mean_sql(r, ok):
    return f"""SELECT zone, '{r.name}' AS name, CASE WHEN avg({r.column}) {ok} THEN 0 ELSE count({r.column}) END AS violations,
      round(CASE WHEN avg({r.column}) {ok} THEN 0 ELSE 1 END::double, 6) AS fraction
      FROM market_sparse WHERE {r.column} IS NOT NULL GROUP BY 1"""


def _fixed_sql(r, status):
    return f"""SELECT DISTINCT zone, '{r.name}' AS name, '{status}' AS status, 0::bigint AS violations,
      0::double AS fraction FROM market_sparse"""


_COUNTED = _union([
    *map(_row_sql, ROW_RULES), *_JUMPS, *_FLATS, *_SPIKES, _time_sql(TIME_RULES[0]),
    _mean_sql(ODD_RULES[4], "> 0"), _mean_sql(ODD_RULES[5], "> 1000000"),
])
_STATUSES = {"absent_column": "skipped", "broken_text": "error", "other_column": "error", "unknown_function": "error"}
_RESULTS = f"""
counted AS ({_COUNTED}),
found AS (
  SELECT zone, name, CASE WHEN violations = 0 THEN 'pass' ELSE 'fail' END AS status, violations, fraction FROM counted
  UNION ALL {_union([_fixed_sql(r, _STATUSES[r.name]) for r in ODD_RULES if r.name in _STATUSES])}),
listed AS (SELECT * FROM (VALUES {", ".join(f"('{r.name}', '{r.column}', '{r.severity}')" for r in ALL_RULES)})
           AS t(name, col, severity)),
results AS (SELECT zone, name, col AS "column", severity, status, violations, fraction FROM found JOIN listed USING (name))"""


def _results(spark, sf_dir):
    return rules.run_rules(_market(spark, sf_dir), ALL_RULES)


@query("rule_results", with_views("SELECT * FROM results", "market_sparse", steps=_RESULTS))
def rule_results(spark, sf_dir):
    results = _results(spark, sf_dir).withColumn("fraction", F.round("fraction", 6))
    return results.select("zone", "name", "column", "severity", "status", "violations", "fraction")


@query("rule_summary", with_views(
    """SELECT zone, count(*) AS total_rules, count(*) FILTER (status = 'pass') AS n_pass,
      count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'error') AS n_error,
      count(*) FILTER (status = 'skipped') AS n_skipped FROM results GROUP BY 1""", "market_sparse", steps=_RESULTS))
def rule_summary(spark, sf_dir):
    return rules.rule_summary(_results(spark, sf_dir))


@query("rule_report", with_views(
    """SELECT zone, name, "column", upper(status) AS status,
      CASE WHEN status IN ('pass', 'fail') THEN cast(violations AS varchar) ELSE '—' END AS violations
    FROM results""", "market_sparse", steps=_RESULTS))
def rule_report(spark, sf_dir):
    return rules.rule_report(_results(spark, sf_dir)).drop("description")


@query("parse_rules", with_views(
    """SELECT zone, 'listed' AS form, 'price_max' AS name, 'price_c' AS "column", 'error' AS severity,
      concat('s <= ', cast(cast(max(price_c) AS bigint) AS varchar)) AS expression, false AS unreadable
    FROM market_sparse GROUP BY 1
    UNION ALL
    SELECT zone, 'wrapped', 'load_min', 'load_c', 'warning',
      concat('s >= ', cast(cast(min(load_c) AS bigint) AS varchar)), false FROM market_sparse GROUP BY 1
    UNION ALL
    SELECT DISTINCT zone, 'broken', NULL, NULL, NULL, NULL, true FROM market_sparse""", "market_sparse"))
def parse_rules(spark, sf_dir):
    """Rule documents written from each zone's own value range, then parsed."""
    ends = market_sparse(spark, sf_dir).groupBy("zone").agg(
        F.max("price_c").cast("bigint").alias("top"), F.min("load_c").cast("bigint").alias("low"))
    listed = F.concat(
        F.lit('```json\n[{"name": "price_max", "description": "", "column": "price_c", "severity": "error", '
              '"expression": "s <= '), F.col("top"), F.lit('"}]\n```'))
    wrapped = F.concat(
        F.lit('{"rules": [{"name": "load_min", "description": "", "column": "load_c", "expression": "s >= '),
        F.col("low"), F.lit('"}]}'))
    broken = F.concat(F.lit('[{"name": "cut'), F.col("top"))
    docs = ends.select(
        "zone",
        F.inline(F.array(
            F.struct(F.lit("listed").alias("form"), listed.alias("document")),
            F.struct(F.lit("wrapped").alias("form"), wrapped.alias("document")),
            F.struct(F.lit("broken").alias("form"), broken.alias("document")),
        )),
    )
    parsed = rules.parse_rule_documents(docs)
    return parsed.select("zone", "form", "name", "column", "severity", "expression",
                         F.col("parse_error").isNotNull().alias("unreadable"))


@query("report_json", with_views(
    f"""SELECT m.zone, m.n_rows, m.first_row, m.expected_hourly_rows, m.load_missing, i.n_issues, i.n_issues = 0 AS passed
    FROM (SELECT zone, count(*) AS n_rows, strftime(min(utc_timestamp), '%Y-%m-%dT%H:%M:%S.000') AS first_row,
            {_EXPECTED} AS expected_hourly_rows, count(*) - count(load_c) AS load_missing
          FROM market_sparse GROUP BY 1) m
    JOIN (SELECT z.zone, count(i.zone) AS n_issues FROM (SELECT DISTINCT zone FROM market_sparse) z
          LEFT JOIN issues i ON i.zone = z.zone GROUP BY 1) i USING (zone)""", "market_sparse", steps=_ISSUES))
def quality_report(spark, sf_dir):
    """Report documents written to JSON, with some of their fields read back."""
    market = _market(spark, sf_dir)
    stats = settle(spark, quality.column_stats(market, COLUMNS, bounds=BOUNDS_C), "column-stats")
    checks = quality.judge(stats, settle(spark, quality.timestamp_stats(market), "timestamp-stats"))
    report = report_json({
        "overview": quality.overview(market, COLUMNS),
        "missing": quality.missing(stats),
        "outliers": quality.bound_violations(stats),
        "issues": quality.issues(checks),
        "verdict": quality.verdict(checks),
    })
    parsed = report.select("zone", F.from_json("report", """
        overview array<struct<n_rows:bigint,start:string,expected_hourly_rows:bigint>>,
        missing array<struct<column:string,missing_count:bigint>>, issues array<struct<kind:string>>,
        verdict array<struct<n_issues:bigint,passed:boolean>>""").alias("r"))
    load = F.filter("r.missing", lambda m: m["column"] == "load_c")[0]["missing_count"]
    return parsed.select(
        "zone",
        F.col("r.overview")[0]["n_rows"].alias("n_rows"),
        F.col("r.overview")[0]["start"].alias("first_row"),
        F.col("r.overview")[0]["expected_hourly_rows"].alias("expected_hourly_rows"),
        load.alias("load_missing"),
        F.size("r.issues").cast("bigint").alias("n_issues"),
        F.col("r.verdict")[0]["passed"].alias("passed"),
    )


# State ------------------------------------------------------------------------


def _long(table: str, column: str, metrics: dict[str, str], source: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT zone, '{table}' AS \"table\", {column} AS \"column\", '{metric}' AS metric, round({value}, 5) AS value FROM {source}"
        for metric, value in metrics.items())


_SINCE = "epoch({})::double"
_PER_COLUMN = _per_column(
    """SELECT zone, '{c}' AS "column", (count(*) - count({c}))::double AS missing_count, (count(*) - count({c})) / count(*) AS missing_fraction,
      count(*) FILTER ({c} < {lo})::double AS below_count, count(*) FILTER ({c} > {hi})::double AS above_count, min({c}) AS "min", max({c}) AS "max",
      quantile_cont({c}, 0.01) AS p01, quantile_cont({c}, 0.99) AS p99, avg({c}) AS mean, stddev_samp({c}) AS std FROM market_sparse GROUP BY 1""")
_FROM_STATE = "\nUNION ALL\n".join([
    _long("overview", "NULL", {"n_rows": "count(*)::double", "expected_hourly_rows": f"{_EXPECTED}::double"},
          "market_sparse GROUP BY zone"),
    _long("overview", "NULL", {"start": _SINCE.format("min(utc_timestamp)"), "end": _SINCE.format("max(utc_timestamp)")}, "market_sparse GROUP BY zone"),
    _long("column", '"column"', {m: f'"{m}"' for m in (
        "missing_count", "missing_fraction", "below_count", "above_count", "min", "max", "p01", "p99", "mean", "std")}, "per_column"),
    _long("timestamps", "NULL", {"gap_count": "count(g.utc_timestamp)::double"},
          "(SELECT DISTINCT zone FROM market_sparse) z LEFT JOIN gaps g USING (zone) GROUP BY zone"),
    """SELECT zone, 'gap_examples', NULL, example_no::varchar, epoch(utc_timestamp)::double FROM (
      SELECT zone, row_number() OVER (PARTITION BY zone ORDER BY utc_timestamp) AS example_no, utc_timestamp FROM gaps) WHERE example_no <= 5""",
    """SELECT zone, 'monthly_coverage', "column", cast(last_day(utc_timestamp) AS varchar), round(avg((value IS NOT NULL)::int), 5) FROM (
      """ + _per_column("SELECT zone, utc_timestamp, '{c}' AS \"column\", {c} AS value FROM market_sparse") + ") GROUP BY 1, 3, 4",
    _long("verdict", "NULL", {"n_issues": "count(i.zone)::double"},
          "(SELECT DISTINCT zone FROM market_sparse) z LEFT JOIN issues i USING (zone) GROUP BY zone"),
])


@query("qa_from_state", with_views(_FROM_STATE, "market_sparse", steps=f"{_ISSUES.strip()},\nper_column AS ({_PER_COLUMN})"))
def qa_from_state(spark, sf_dir):
    """All tables of the quality report in long form, from one stored state that was made in two steps."""
    market = _market(spark, sf_dir)
    zones = F.col("zone").isin("Z0", "Z1")
    state = settle(spark, quality_state(market.filter(zones), COLUMNS), "quality-state")
    state = settle(spark, updated(state, quality_state(market.filter(~zones), COLUMNS)), "quality-state")
    tables = tables_from_state(state, COLUMNS, bounds=BOUNDS_C)
    since = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    nothing = F.lit(None).cast("string")

    def long(table, frame, column, **metrics):
        cells = [F.struct(F.lit(m).alias("metric"), F.round(v.cast("double"), 5).alias("value")) for m, v in metrics.items()]
        return frame.select("zone", F.lit(table).alias("table"), column.alias("column"), F.inline(F.array(*cells)))

    named = lambda *names: {n: F.col(n) for n in names}
    by_month = tables["monthly_coverage"]
    gaps = tables["gap_examples"]
    parts = [
        long("overview", tables["overview"], nothing, **named("n_rows", "expected_hourly_rows"), start=since("start"), end=since("end")),
        long("column", tables["missing"], F.col("column"), **named("missing_count", "missing_fraction")),
        long("column", tables["outliers"], F.col("column"), **named("below_count", "above_count")),
        long("column", tables["range_stats"], F.col("column"), **named("min", "max", "p01", "p99")),
        long("column", tables["profile"], F.col("column"), **named("mean", "std")),
        long("timestamps", tables["timestamps"], nothing, **named("gap_count")),
        gaps.select("zone", F.lit("gap_examples").alias("table"), nothing.alias("column"), F.col("example_no").cast("string").alias("metric"), since("utc_timestamp").alias("value")),
        by_month.select("zone", F.lit("monthly_coverage").alias("table"), "column", F.col("month_end").cast("string").alias("metric"), F.round("coverage", 5).alias("value")),
        long("verdict", tables["verdict"], nothing, **named("n_issues")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
