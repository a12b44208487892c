from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest

from wattline.config import DOMAIN_BOUNDS
from wattline.operators import quality, rules
from wattline.operators.rules import Rule


def market(n=100):
    index = pd.date_range("2024-01-01", periods=n, freq="h")
    rng = np.random.default_rng(5)
    return pd.DataFrame(
        {"price_da_eur_mwh": rng.normal(80, 20, n), "load_mwh": rng.normal(50_000, 5_000, n)}, index=index
    )


def test_checks_on_a_damaged_table(hourly):
    frame = market()
    frame.iloc[3, 0] = 5000.0
    frame.iloc[4:14, 1] = np.nan
    frame = pd.concat([frame.iloc[:50], frame.iloc[80:], frame.iloc[:2], frame.iloc[:1]])
    df = hourly(frame)
    columns = list(frame.columns)
    stats = quality.column_stats(df, columns)
    duplicates, gaps = quality.duplicate_counts(df), quality.gap_counts(df)
    assert duplicates.first()["duplicate_count"] == 3
    assert [r["utc_timestamp"] for r in quality.duplicate_examples(df).orderBy("example_no").collect()] == [
        datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 1)]
    assert gaps.first()["gap_count"] == 30
    assert quality.gap_hours(df).count() == 30
    over = quality.overview(df, columns).first()
    assert (over["n_rows"], over["n_cols"], over["expected_hourly_rows"]) == (73, 2, 100)
    checks = quality.judge(stats, quality.timestamp_stats(df))
    found = quality.issues(checks)
    assert {(r["kind"], r["column"]) for r in found.collect()} == {
        ("missing", "load_mwh"), ("duplicates", "utc_timestamp"), ("gaps", "utc_timestamp"), ("bounds", "price_da_eur_mwh")}
    assert {r["message"] for r in found.collect()} >= {"load_mwh: 13.7% missing", "30 hourly gaps"}
    verdict = quality.verdict(checks).first()
    assert verdict["n_issues"] == 4 and not verdict["passed"]


def test_clean_table_passes(hourly):
    df = hourly(market())
    stats = quality.column_stats(df, ["price_da_eur_mwh", "load_mwh"], bounds=DOMAIN_BOUNDS)
    assert quality.verdict(quality.judge(stats, quality.timestamp_stats(df))).first()["passed"]


def test_off_grid_rows_do_not_fill_gaps(spark):
    times = ["2024-01-01 00:00", "2024-01-01 01:30", "2024-01-01 03:00"]
    df = spark.createDataFrame([("DE", datetime.fromisoformat(t)) for t in times], "zone string, utc_timestamp timestamp_ntz")
    assert quality.gap_counts(df).first()["gap_count"] == quality.gap_hours(df).count() == 2


def test_month_without_rows_has_null_coverage(hourly):
    frame = market(24 * 31 * 5)
    frame = frame[frame.index.month != 3]
    coverage = quality.monthly_coverage(hourly(frame), ["load_mwh"]).orderBy("month_end").collect()
    assert [(r["month_end"], r["coverage"]) for r in coverage][:4] == [
        (date(2024, 1, 31), 1.0), (date(2024, 2, 29), 1.0), (date(2024, 3, 31), None), (date(2024, 4, 30), 1.0)]


def test_rule_forms(hourly):
    """Sequence rules count the first row, where there is nothing to compare with."""
    frame = pd.DataFrame(
        {"p": [10.0, 12.0, np.nan, 90.0, 90.0, 90.0, 90.0, 500.0, 501.0]},
        index=pd.date_range("2024-01-01", periods=9, freq="h"))
    list_ = [
        Rule("low", "p", "s >= 11"),
        Rule("jump", "p", "jump(50)"),
        Rule("flat", "p", "flatline(3)"),
        Rule("spike", "p", "spike(400, 4, 1)"),
        Rule("hours", "index", "minute(s) = 0"),
        Rule("mean", "p", "avg(s) between 0 and 1000"),
        Rule("scalar", "p", "false"),
        Rule("absent", "q", "s > 0"),
        Rule("bad", "p", "s >"),
        Rule("stranger", "p", "zone = 'DE'"),
        Rule("window", "p", "s > lag(s) over (order by s)"),
        Rule("text", "zone", "jump(1)"),
    ]
    got = {r["name"]: (r["status"], r["violations"]) for r in rules.run_rules(hourly(frame), list_, block_steps=3).collect()}
    assert got == {
        "low": ("fail", 1), "jump": ("fail", 3), "flat": ("fail", 3), "spike": ("fail", 1), "hours": ("pass", 0),
        "mean": ("pass", 0), "scalar": ("fail", 8), "absent": ("skipped", 0), "bad": ("error", 0), "stranger": ("error", 0),
        "window": ("error", 0), "text": ("error", 0)}
    relaxed = rules.run_rules(hourly(frame), list_[1:3], first_row_passes=True)
    assert {r["name"]: r["violations"] for r in relaxed.collect()} == {"jump": 2, "flat": 2}


def test_rules_per_zone_and_empty_column(hourly):
    a = hourly(pd.DataFrame({"p": [1.0, -1.0]}, index=pd.date_range("2024-01-01", periods=2, freq="h")), "A")
    b = hourly(pd.DataFrame({"p": [np.nan]}, index=pd.date_range("2024-01-01", periods=1, freq="h")), "B")
    results = rules.run_rules(a.unionByName(b), [Rule("positive", "p", "s > 0")])
    got = {r["zone"]: (r["status"], r["violations"], r["fraction"]) for r in results.collect()}
    assert got == {"A": ("fail", 1, 0.5), "B": ("pass", 0, 0.0)}
    summary = {r["zone"]: (r["total_rules"], r["n_pass"], r["n_fail"]) for r in rules.rule_summary(results).collect()}
    assert summary == {"A": (1, 0, 1), "B": (1, 1, 0)}


@pytest.mark.parametrize(
    "text, names",
    [
        ('[{"name": "a", "column": "p", "expression": "s > 0"}]', ["a"]),
        ('```json\n{"rules": [{"name": "a", "column": "p", "expression": "s > 0"}]}\n```', ["a"]),
        ('  ```\n[{"name": "a"}, {"name": "b"}]', ["a", "b"]),
        ("{}", []),
        ("[]", []),
        ("not json", None),
        ('[{"name": "a"', None),
    ],
)
def test_rule_documents(spark, text, names):
    rows = rules.parse_rule_documents(spark.createDataFrame([(1, text)], "id int, document string")).collect()
    if names is None:
        assert len(rows) == 1 and rows[0]["parse_error"]
    else:
        assert [r["name"] for r in rows] == names and all(r["parse_error"] is None for r in rows)


def test_parsed_rules_run(spark, hourly):
    text = '```json\n[{"name": "a", "column": "p", "severity": "error", "expression": "s > 0"}]\n```'
    table = rules.parse_rule_documents(spark.createDataFrame([(text,)], "document string"))
    assert rules.rules_from_rows(table) == [Rule("a", "p", "s > 0", "", "error")]


def test_a_predicate_that_fails_on_a_value_is_a_violation_there(hourly, spark):
    frame = pd.DataFrame({"p": [10.0, 12.0]}, index=pd.date_range("2024-01-01", periods=2, freq="h"))
    list_ = [Rule("division", "p", "1 / (s - 10) > 0 and s is not null"), Rule("infinite", "p", "1 / (s - 10) > 0"), Rule("cast", "p", "cast('x' as int) > s"), Rule("fine", "p", "s > 0")]
    got = {r["name"]: (r["status"], r["violations"]) for r in rules.run_rules(hourly(frame), list_).collect()}
    assert got == {"division": ("fail", 1), "infinite": ("pass", 0), "cast": ("fail", 2), "fine": ("pass", 0)}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
