"""Provenance of features."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wattline.config import FUNDAMENTALS, PRICE
from wattline.operators import features
from wattline.operators.features import FeatureSpec
from wattline.operators.leakage import leakage_report


def market(n=500, seed=1, gaps=0.0):
    r = np.random.default_rng(seed)
    frame = pd.DataFrame({PRICE: r.normal(80, 30, n)}, index=pd.date_range("2024-01-01", periods=n, freq="h"))
    for c in FUNDAMENTALS:
        frame[c] = np.where(r.random(n) < gaps, np.nan, r.uniform(1, 9, n))
    return frame


def by_name(report):
    return {r["feature"]: r for r in report.collect()}


def test_least_gaps_of_the_day_ahead_set(hourly):
    for mode in ("time",):
        got = by_name(leakage_report(hourly(market()), lag_mode=mode))
        inputs = set(features.feature_matrix(hourly(market())).columns) - {"zone", "utc_timestamp", PRICE} - set(features.CALENDAR)
        assert set(got) == inputs
        assert all(r["n_leaks"] == 0 and r["n_rows"] > 0 for r in got.values())
        assert {c: got[f"price_lag_{c}h"]["least_gap_steps"] for c in (24, 48, 336)} == {24: 24, 48: 48, 336: 336}
        assert got["price_roll_168h_std"]["least_gap_steps"] == got["load_mwh_roll24_mean"]["least_gap_steps"] == got["renewables_total_lag24"]["least_gap_steps"] == 24


def test_a_planted_lag_is_found(hourly):
    got = by_name(leakage_report(hourly(market()), FeatureSpec(lags=(23, 48))))
    assert got["price_lag_23h"]["least_gap_steps"] == 23 and got["price_lag_23h"]["n_leaks"] == 500 - 23
    assert sum(r["n_leaks"] > 0 for r in got.values()) == 1


def test_a_planted_window_and_sum_are_found(hourly):
    def build(laid, spec):
        laid = laid.with_columns({
            "near_mean": laid.full(F.avg(PRICE), PRICE, 6, 3),
            "filled": laid.over(F.last("load_mwh", ignorenulls=True), 4, 30),
            "_both": laid.joint(F.col(PRICE) * F.col("load_mwh"), PRICE, "load_mwh"),
        })
        return laid.with_columns({"product": laid.lag("_both", 25)}).drop("_both")

    got = by_name(leakage_report(hourly(market(gaps=0.3)), build=build))
    assert got["near_mean"]["least_gap_steps"] == 3 and got["near_mean"]["n_leaks"] == got["near_mean"]["n_rows"] == 500 - 8
    assert got["filled"]["least_gap_steps"] == 30 and got["filled"]["n_leaks"] == 0
    assert got["product"]["least_gap_steps"] == 25 and got["product"]["n_rows"] < 475


def test_gaps_widen_over_removed_rows(hourly):
    frame = market()
    kept = frame.drop(frame.index[200:260])
    got = by_name(leakage_report(hourly(kept)))
    assert got["price_lag_24h"]["least_gap_steps"] == 24 and all(r["n_leaks"] == 0 for r in got.values())


def test_a_feature_that_is_never_there(hourly):
    got = by_name(leakage_report(hourly(market(100))))
    assert got["price_lag_336h"]["least_gap_steps"] is None and got["price_lag_336h"]["n_rows"] == 0


def test_any_pair_of_windows_against_pandas(hourly):
    frame = market(700, seed=3)
    frame.iloc[300, 0] = np.nan
    for mode, pairs in (("row", ((24, 100), (1, 2))), ("time", ((33, 257),))):
        for short, long in pairs:
            spec = FeatureSpec(lags=(24,), short_window=short, long_window=long, fundamentals=())
            laid = features.lay_out(hourly(frame[[PRICE]]), spec, lag_mode=mode, block_steps=100)
            got = features.price_features(laid, spec).own_rows().toPandas().set_index("utc_timestamp").sort_index()
            s = frame[PRICE].shift(24)
            wanted = {
                f"price_roll_{short}h_max": s.rolling(short).max(), f"price_roll_{short}h_min": s.rolling(short).min(),
                f"price_roll_{long}h_mean": s.rolling(long).mean(), f"price_roll_{long}h_std": s.rolling(long).std(),
                f"price_roll_{short}h_mean": s.rolling(short).mean(),
            }
            for name, want in wanted.items():
                np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-7, err_msg=f"{mode} {name}")
