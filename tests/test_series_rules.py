"""Rules in series notation against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.functions.order_statistics import window_quantiles
from wattline.operators import rules
from wattline.operators.rules import Rule
from wattline.operators.series_text import Program
from wattline.plans.blocks import block_series
from wattline.plans.ranks import value_places
from wattline.plans.scans import Scan, faded, with_scans
from wattline.plans.sliding import WindowQuantile, with_window_quantiles

FORMS = [
    # neighbours and windows, nested ones too
    "s.diff() > -60", "s.diff(-2) <= 90", "s.shift(-3) > s - 100", "s.pct_change().abs() < 3", "s.diff().abs().rolling(5).mean() < 90",
    "s.rolling(6, center=True).mean() > 120", "s.rolling(7, min_periods=2, center=True).std() > 30", "s.diff().rolling(4, min_periods=1).std() < 140",
    "s.rolling(5).median() > 100", "s.rolling(50, min_periods=3).quantile(0.9) <= 260", "(s - s.rolling(24, min_periods=1).median()).abs() <= 120",
    "s.rolling(8, center=True, min_periods=1).quantile(0.25) > 40", "s.rolling(3).count() == 3", "s.rolling(4).var() > 1000", "s.diff().rolling(9, min_periods=2).median() < 30",
    # running values
    "s.cumsum() % 3 != 0", "s < s.cummax() * 0.95", "s > s.cummin()", "s >= s.expanding().mean() * 0.3", "s.expanding(min_periods=10).max() > 290",
    "s.ewm(span=10).mean() < 180", "s.ewm(alpha=0.3, adjust=False).mean() > 90", "s.ewm(com=0).mean() == s", "s.ewm(halflife=4).mean().diff().abs() < 30",
    "s.diff().cumsum().fillna(0) > -150", "s.expanding().count() > 20", "s.diff().cummax() < 280", "s.cumsum().diff().fillna(7) < 290",
    # places
    "s.rank() > 100", "s.rank(pct=True) <= 0.9", "s.rank(method='min', ascending=False) > 7", "s.rank(method='dense') > 20", "s.rank(method='max', pct=True) < 0.8",
    "s.rank(method='dense', pct=True, ascending=False) > 0.1", "~s.duplicated()", "s.duplicated(keep='last')", "~s.duplicated(keep=False)", "s.diff().rank() > 30",
    # single values
    "s.mean() > 0", "s.std() > 500", "s.quantile(.99) < 500", "(s > 0).mean() > 0.99", "(s > 0).all()", "(s > 299).any()", "s.nunique() > 10", "s.is_monotonic_increasing",
    "s.cumsum().is_monotonic_increasing", "s.is_unique", "s.rank().is_unique", "len(s) > 100", "s.size > 1000", "0 < s.mean() < 400", "s.mean() > 0 and s.std() < 1", "not s.max() > 1000",
    "(s - s.mean()).abs() <= 2 * s.std()", "s <= s.quantile(0.75) + 0.5 * (s.quantile(0.75) - s.quantile(0.25))", "s.median() > s.diff().std()", "s.std(ddof=0) > 1", "(s > s.shift()).sum() > 200",
    "(s - s.rolling(24, min_periods=1).mean()).std() > 10", "s.diff().dropna().abs() < 150", "s.diff().dropna().mean() < 1", "s.min() >= 0", "s.count() == len(s)",
    # arithmetic as in floating point
    "s / 0 > 1", "1 / (s - s.min()) > 0", "s % 7 != 3", "-s % 7 > 1", "s % -7 < -1", "s ** 2 < 40000", "s // 25 < 8", "-s // 25 < -4", "(s / 7).round(1) * 7 < 200", "s.round(-2) != 100",
    "s.clip(20, 200).diff().abs() < 150", "s.clip(upper=s.mean()) < 100", "s.isna() == False", "s.notna() != False", "s.between(10, 20, inclusive='neither')", "s.sub(5).abs().ge(20)",
    "(s > 10) ^ (s < 100)", "s.isin([1, 2, 3])", "np.abs(s - 150) < 140", "np.log(s) > 1", "s.astype(float) > 3", "(s > 5).astype(int).rolling(3, min_periods=1).sum() >= 1", "s.diff().isna()", "abs(s) < 290", "s % 0 > 1",
]
REFUSED = [
    "s.map(print) == 1", "s.apply(lambda x: x > 0)", "__import__('os').system('x') == 0", "s.rolling(3).apply(max) > 0", "s.rolling(0).mean() > 0", "s.shift(1.5) > 0", "s.index > 3",
    "s.mean()", "s.rolling(s) > 0", "s.ewm(span=0).mean() > 0", "s.ewm(span=3, com=2).mean() > 0", "s.diff().ewm(span=3).mean() > 0", "s.diff().duplicated()", "s.rank(method='first') > 1", "open('x')", "s.__class__", "s > 1 > 0",
    "s.diff().dropna().rolling(2).mean() > 0", "(s.diff().dropna() > 0) & (s > 0)", "s.quantile(2) > 0", "np.random.rand(3) > s", "s.rolling(3) > 0", "df['x'] > 0",
]


@pytest.fixture(scope="module")
def series():
    r = np.random.default_rng(6)
    values = pd.Series(r.integers(0, 300, 400).astype(float), index=pd.date_range("2024-01-01", periods=400, freq="h"))
    values.iloc[r.integers(0, 400, 30)] = np.nan
    return values


def wanted(text, s):
    mask = eval(text, {"s": s, "np": np})
    if not isinstance(mask, pd.Series):
        mask = pd.Series([bool(mask)] * len(s), index=s.index)
    return int((~mask).sum())


@pytest.mark.parametrize("block", [720, 7])
def test_forms_against_pandas(hourly, series, block):
    forms = FORMS if block == 720 else [f for f in FORMS if "rolling(" in f or "cum" in f or "ewm" in f or "shift" in f]
    with np.errstate(all="ignore"):
        want = {t: wanted(t, series.dropna()) for t in forms}
    frame = hourly(pd.DataFrame({"p": series, "q": series * 2 + 1}))
    got = rules.run_rules(frame, [Rule(t, "p", t) for t in forms] + [Rule("other", "q", "s.diff().abs() <= 150")], block_steps=block).collect()
    assert {r["name"]: (r["violations"], r["error"]) for r in got if r["name"] != "other"} == {t: (v, None) for t, v in want.items()}
    assert all(r["status"] == ("fail" if r["violations"] else "pass") for r in got)
    (other,) = [r["violations"] for r in got if r["name"] == "other"]
    assert other == wanted("s.diff().abs() <= 150", series.dropna() * 2 + 1)


WHOLE = [
    "s.diff() > -60", "s.shift(-3) > s - 100", "s.rolling(5).median() > 100", "s.rolling(50, min_periods=3).quantile(0.9) <= 260",
    "s.rolling(8, center=True, min_periods=1).quantile(0.25) > 40", "s.cumsum() % 3 != 0", "s < s.cummax() * 0.95", "s > s.cummin()", "s.expanding(min_periods=10).max() > 290",
    "s.ewm(span=10).mean() < 180", "s.ewm(alpha=0.3, adjust=False).mean() > 90", "s.cumsum().diff().fillna(7) < 290", "s.rank() > 100", "s.rank(pct=True) <= 0.9",
    "s.rank(method='min', ascending=False) > 7", "s.rank(method='dense') > 20", "s.rank(method='max', pct=True) < 0.8", "s.rank(method='dense', pct=True, ascending=False) > 0.1",
    "~s.duplicated()", "s.duplicated(keep='last')", "~s.duplicated(keep=False)", "(s - s.mean()).abs() <= 2 * s.std()", "s.var() > s.std(ddof=0)", "s < s.median()", "s.nunique() > 10",
    "s <= s.quantile(0.75) + 0.5 * (s.quantile(0.75) - s.quantile(0.25))", "s < s.max() * 0.9", "s.sum() > s * 100", "s.count() == len(s)", "s.min() >= 0",
]
SEQUENCES = ["jump(90)", "flatline(2)", "flatline(5)", "flatline(1)", "spike(250, 4, 1)", "spike(250, 0, 0)"]


@pytest.mark.parametrize("first", [False, True])
def test_whole_zones_need_no_positions(spark, series, monkeypatch, first):
    """Zones no longer than a block are judged in one pass, with the counts of the blocked passes and of pandas."""
    texts = WHOLE + SEQUENCES
    short = series.iloc[:7].round(-2)
    zones = {"a": series, "b": short, "c": series * np.nan, "d": series.round(-2).iloc[:90]}
    names = [f"c{i}" for i in range(len(texts))]
    rows = [(zone, at.to_pydatetime(), *[None if np.isnan(v) else float(v)] * len(texts)) for zone, s in zones.items() for at, v in s.items()]
    frame = spark.createDataFrame(rows, "zone string, utc_timestamp timestamp_ntz, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    wanted_rules = [Rule(text, c, text) for c, text in zip(names, texts)]

    def counts(**given):
        return {(r.zone, r.name): (r.violations, r.status, r.error) for r in rules.run_rules(frame, wanted_rules, first_row_passes=first, **given).collect()}

    # Zones of 400 rows are longer than such a block.
    blocked = counts(block_steps=300)
    with monkeypatch.context() as patched:
        for module in ("wattline.operators.series_rules", "wattline.plans.blocks"):
            patched.setattr(f"{module}.row_positions", None)
        whole = counts()
    assert whole == blocked and len(whole) == 4 * len(texts)
    assert all(status != "error" for _, status, _ in whole.values())
    for text in WHOLE:
        for zone, s in zones.items():
            s = s.dropna()
            assert whole[zone, text][0] == (wanted(text, s) if len(s) else 0), (zone, text)


def test_rows_without_a_time_take_the_blocked_passes(spark, series):
    rows = [("a", at.to_pydatetime(), None if np.isnan(v) else float(v)) for at, v in series.items()] + [("a", None, 5.0), ("a", None, 250.0)]
    frame = spark.createDataFrame(rows, "zone string, utc_timestamp timestamp_ntz, v double")
    texts = ["s.ewm(span=24).mean() < 160", "s.ewm(alpha=0.3, adjust=False).mean() > 150", "s.diff().abs() <= 90", "s.rank() > 100"]

    def counts(**given):
        return sorted((r.name, r.violations, r.fraction) for r in rules.run_rules(frame, [Rule(t, "v", t) for t in texts], **given).collect())

    assert counts() == counts(block_steps=300)


def test_refused(hourly, series):
    got = rules.run_rules(hourly(pd.DataFrame({"p": series})), [Rule(t, "p", t) for t in REFUSED]).collect()
    assert {r["name"]: r["status"] for r in got} == {t: "error" for t in REFUSED}


def test_a_refused_rule_leaves_no_steps():
    program = Program()
    program.read("s.diff() > 0", "p")
    for text in REFUSED:
        with pytest.raises(ValueError):
            program.read(text, "p")
    assert len(program.steps) == 1
    program.read("s.diff() > 5", "q")
    assert len(program.steps) == 1


def test_zones_are_apart_and_text_columns_refused(spark, hourly, series):
    one = hourly(pd.DataFrame({"p": series}), "A")
    two = hourly(pd.DataFrame({"p": series.iloc[::-1].set_axis(series.index)}), "B").withColumn("name", F.lit("x"))
    frame = one.withColumn("name", F.lit("x")).unionByName(two)
    texts = ["s.cumsum() % 3 != 0", "s.rank() > 100", "s.rolling(9).median() > 100", "s.mean() > 149.9"]
    got = rules.run_rules(frame, [Rule(t, "p", t) for t in texts] + [Rule("text", "name", "s.diff() > 0")]).collect()
    flipped = series.iloc[::-1].set_axis(series.index)
    for r in got:
        if r["name"] != "text":
            assert r["violations"] == wanted(r["name"], (series if r["zone"] == "A" else flipped).dropna()), r
    assert {r["status"] for r in got if r["name"] == "text"} == {"error"}


def test_empty_and_missing_columns(hourly, series):
    frame = hourly(pd.DataFrame({"p": series, "q": series * np.nan}))
    list_ = [Rule(t, "q", t) for t in ("s.mean() > 0", "s.rolling(3).median() > 0", "s.rank() > 0", "s.is_unique")]
    assert {(r["violations"], r["status"]) for r in rules.run_rules(frame, list_).collect()} == {(0, "pass")}
    assert rules.run_rules(frame.filter("false"), list_).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_window_quantiles_against_pandas(seed):
    r = np.random.default_rng(seed)
    values = r.integers(0, 4 if seed % 2 else 1000, 300).astype(float)
    values[r.random(300) < 0.1 * (seed % 3)] = np.nan
    s = pd.Series(values)
    for size, least, center in ((1, 1, False), (7, 3, False), (24, 24, False), (400, 1, False), (8, 2, True), (9, 9, True)):
        ahead = (size - 1) // 2 if center else 0
        for q in (0.0, 0.1, 0.5, 0.99, 1.0):
            (got,) = window_quantiles(values, size, ahead, [(q, least)])
            np.testing.assert_allclose(got, s.rolling(size, min_periods=least, center=center).quantile(q), rtol=1e-12)
    assert np.isnan(window_quantiles(np.full(4, np.nan), 2, 0, [(0.5, 1)])[0]).all() and len(window_quantiles(np.zeros(0), 2, 0, [(0.5, 1)])[0]) == 0


def test_year_window_on_a_million_rows(spark):
    """A window of 8 760 rows; halos are at most as long as the blocks, and every row costs the logarithm of its block."""
    rows = spark.range(1_000_000).select(F.lit("A").alias("zone"), F.col("id").alias("row"), ((F.col("id") * 7919) % 100_003).cast("double").alias("x"))
    laid = block_series(rows, ["zone"], "row", look_back=8759, mode="placed", block_steps=8760)
    found = with_window_quantiles(laid, {"m": WindowQuantile("x", 0.5, 8760, 8760)}).own_rows()
    got = found.filter("row in (8758, 8759, 500000, 999999)").orderBy("row").collect()
    assert found.count() == 1_000_000
    x = (np.arange(1_000_000) * 7919) % 100_003
    assert [r["m"] for r in got] == [None] + [float(np.median(x[i - 8759 : i + 1])) for i in (8759, 500000, 999999)]


@pytest.mark.parametrize("steps", [1, 7, 8192])
def test_scans_in_blocks(spark, steps):
    r = np.random.default_rng(2)
    values = r.normal(100, 30, 300)
    holes = np.where(r.random(300) < 0.2, np.nan, values)
    frame = pd.DataFrame({"zone": ["A"] * 300 + ["B"] * 300, "row": [*range(300)] * 2, "x": [*values, *values[::-1]], "y": [*holes, *holes]})
    rows = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(5)
    scans = {
        "total": Scan("sum", "y", gaps=True), "most": Scan("max", "y"), "least": Scan("min", "y", gaps=True), "seen": Scan("count", "y"),
        "fading": Scan("ewm", "x", keep=0.9), "smooth": Scan("ewm", "x", keep=0.75, mean=False), "plain": Scan("ewm", "x", keep=0.0),
    }
    got = with_scans(rows, ["zone"], "row", scans, steps).toPandas().sort_values(["zone", "row"]).reset_index(drop=True)
    for zone in ("A", "B"):
        have, s = got[got.zone == zone].reset_index(drop=True), frame[frame.zone == zone].reset_index(drop=True)
        for name, want in {
            "total": s.y.cumsum(), "most": s.y.expanding().max(), "least": s.y.cummin(), "seen": s.y.expanding().count(),
            "fading": s.x.ewm(alpha=0.1).mean(), "smooth": s.x.ewm(alpha=0.25, adjust=False).mean(), "plain": s.x,
        }.items():
            np.testing.assert_allclose(have[name].astype(float), want.to_numpy(), rtol=1e-11, err_msg=name)


def test_faded_is_the_recurrence():
    values, before, want = np.arange(1.0, 200.0), 0.0, []
    for v in values:
        before = 0.97 * before + v
        want.append(before)
    np.testing.assert_allclose(faded(values, 0.97), want, rtol=1e-13)


@pytest.mark.parametrize("ranges", [2, 5, 512])
def test_places_with_a_hot_value(spark, ranges):
    r = np.random.default_rng(4)
    values = np.where(r.random(900) < 0.4, 50.0, r.integers(0, 200, 900).astype(float))
    frame = pd.DataFrame({"zone": ["A"] * 600 + ["B"] * 300, "row": [*range(600), *range(300)], "x": values})
    got = value_places(spark.createDataFrame(frame).repartition(4), ["zone"], "x", "row", ranges).collect()
    for zone, part in frame.groupby("zone"):
        want = {v: ((part.x == v).sum(), part.row[part.x == v].min(), part.row[part.x == v].max(), (part.x < v).sum(), part.x[part.x < v].nunique()) for v in part.x.unique()}
        assert {g["x"]: (g["_n"], g["_first"], g["_last"], g["_less"], g["_kinds"]) for g in got if g["zone"] == zone} == want


def test_blocks_that_look_ahead(spark):
    rows = spark.range(50).select(F.lit("A").alias("zone"), F.col("id").alias("row"), F.col("id").cast("double").alias("x"))
    for steps in (1, 4, 100):
        laid = block_series(rows, ["zone"], "row", look_back=3, look_ahead=2, mode="placed", block_steps=steps)
        done = laid.with_columns({"before": laid.lag("x", 3), "after": laid.lag("x", -2), "mean": laid.over(F.avg("x"), 6, -2)}).own_rows().orderBy("row").collect()
        assert len(done) == 50
        for i, r in enumerate(done):
            assert r["before"] == (i - 3 if i >= 3 else None) and r["after"] == (i + 2 if i < 48 else None)
            assert r["mean"] == np.mean(range(max(i - 3, 0), min(i + 3, 50)))


def test_exact_percentiles_of_sql_rules_hold_no_zone_in_a_buffer(hourly, series):
    frame = hourly(pd.DataFrame({"p": series}))
    texts = ["percentile(s, 0.99) < 290", "percentile(s, 0.5) > avg(s) - 20", "s <= percentile(s, 0.9)"]
    got = rules.run_rules(frame, [Rule(t, "p", t) for t in texts])
    s = series.dropna()
    want = [0 if s.quantile(0.99) < 290 else len(s), 0 if s.median() > s.mean() - 20 else len(s), int((s > s.quantile(0.9)).sum())]
    assert {r["name"]: (r["violations"], r["error"]) for r in got.collect()} == {t: (w, None) for t, w in zip(texts, want)}
