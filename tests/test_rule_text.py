"""Rule expressions: what is read, translated and refused."""

import pandas as pd
import pytest

from wattline.operators import rules
from wattline.operators.rule_text import checked
from wattline.operators.rules import Rule


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("s between 0 and 5", "s between 0 and 5"),
        ("avg(s) > 0", "avg(s) > 0"),
        ("(s >= 30000) & (s <= 80000)", "((s >= 30000) and (s <= 80000))"),
        ("~(s == 3) | s.isin([1, 2.5])", "((not (s = 3)) or (s in (1, 2.5)))"),
        ("s.between(-1, 4)", "(s between -1 and 4)"),
        ("s.abs() <= 2 * 3", None),
        ("s.diff().abs() <= 150", "jump(150)"),
        ("s.rolling(12, min_periods=1).std() > 0", "flatline(12)"),
        ("(s <= 4) | (s.rolling(window=168, min_periods=1).apply(lambda x: (x > 4).sum()) <= 1)", "spike(4, 168, 1)"),
    ],
)
def test_read(text, wanted):
    assert checked(text) == (wanted or "(abs(s) <= (2 * 3))")


@pytest.mark.parametrize(
    "text",
    [
        None, "", "  ", "raise_error('x') is null", "assert_true(s < 10) is null", "java_method('java.lang.System', 'exit', '0')",
        "rand() > 0.5", "s > (select 1)", "s in (select id from t)", "lag(s) over (order by s) > 0", "reflect('a', 'b')",
        "s.apply(lambda x: x > 0)", "s.map(print) == 1", "__import__('os').system('x') == 0", "s.rolling(3).std() > 0",
        "(s <= 4) | (s.rolling(window=168, min_periods=1).apply(lambda x: (x > 5).sum()) <= 1)", "s & ", "s.diff() > 0", "input_file_name() = s",
    ],
)
def test_refused(text):
    with pytest.raises(ValueError):
        checked(text)


def test_refused_rules_stop_nothing(hourly):
    frame = pd.DataFrame({"p": [10.0, 12.0]}, index=pd.date_range("2024-01-01", periods=2, freq="h"))
    list_ = [Rule("raises", "p", "raise_error('x') is null"), Rule("none", "p", None), Rule("random", "p", "rand() > 0.5"),
             Rule("fine", "p", "(s > 0) & (s < 11)")]
    got = {r["name"]: (r["status"], r["violations"]) for r in rules.run_rules(hourly(frame), list_).collect()}
    assert got == {"raises": ("error", 0), "none": ("error", 0), "random": ("error", 0), "fine": ("fail", 1)}


def test_any_number_of_rules(hourly, monkeypatch):
    frame = pd.DataFrame({"p": [10.0]}, index=pd.date_range("2024-01-01", periods=1, freq="h"))
    monkeypatch.setattr(rules, "BATCH", 7)
    got = rules.run_rules(hourly(frame), [Rule(f"r{i}", "p", f"s > {i}") for i in range(30)]).collect()
    assert {r["name"]: r["status"] for r in got} == {f"r{i}": "pass" if i < 10 else "fail" for i in range(30)}


def test_documents_with_more_behind_them(spark):
    docs = spark.createDataFrame([('[{"name": "a"}] trailing words',)], "document string")
    table = rules.parse_rule_documents(docs)
    assert table.first()["parse_error"]
    with pytest.raises(ValueError, match="rule documents"):
        rules.rules_from_rows(table)


def test_rules_on_other_rows_against_pandas(hourly):
    import numpy as np

    r = np.random.default_rng(6)
    frame = pd.DataFrame({"p": r.integers(0, 300, 500).astype(float)}, index=pd.date_range("2024-01-01", periods=500, freq="h"))
    frame.iloc[r.integers(0, 500, 40), 0] = np.nan
    texts = [
        "s.diff().abs() < 150", "(s.diff().abs() <= 150) & (s >= 20)", "s.diff() > 0", "s.diff(periods=3) != 0", "s.shift(2) <= s + 40",
        "s - s.shift() < 100", "s.rolling(5).mean() > 120", "s.rolling(4, min_periods=1).sum() <= 900", "s.rolling(3).std() > 30",
        "(s <= s.rolling(24, min_periods=2).max()) | (s.rolling(window=6).min() < 50)", "~(s.shift(1) == s)", "s.diff().between(-90, 90)", "s.shift(3).notna()",
    ]
    for block in (720, 7):
        got = rules.run_rules(hourly(frame), [Rule(t, "p", t) for t in texts], block_steps=block).collect()
        s = frame["p"].dropna()
        wanted = {t: int((~eval(t, {"s": s})).sum()) for t in texts}
        assert {r["name"]: r["violations"] for r in got} == wanted
        assert all(r["status"] == ("fail" if wanted[r["name"]] else "pass") for r in got)
