import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from wattline.config import FUNDAMENTALS, PRICE
from wattline.operators import cleaning, features


def market(n, seed=0):
    index = pd.date_range("2024-02-20", periods=n, freq="h")
    rng = np.random.default_rng(seed)
    columns = {PRICE: rng.normal(80, 30, n)}
    columns.update({c: rng.uniform(100, 5000, n) for c in FUNDAMENTALS})
    return pd.DataFrame(columns, index=index)


def matrix(df, **options):
    return features.feature_matrix(df, **options).toPandas().set_index("utc_timestamp").sort_index()


def test_full_set_has_37_features_and_onshore_with_solar_31(hourly):
    df = hourly(market(400))
    keys = ("zone", "utc_timestamp", PRICE)
    assert len([c for c in features.feature_matrix(df).columns if c not in keys]) == 37
    fewer = features.feature_matrix(df.drop("wind_offshore_mwh", "load_mwh"))
    assert len([c for c in fewer.columns if c not in keys]) == 31


def test_first_complete_row_follows_the_longest_lag(hourly):
    got = matrix(hourly(market(400)))
    assert len(got) == 400 - 336


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(at=st.integers(340, 399), column=st.sampled_from([PRICE, *FUNDAMENTALS]))
def test_nothing_newer_than_24_hours_enters_a_feature(hourly, at, column):
    frame = market(430)
    changed = frame.copy()
    changed.iloc[at, changed.columns.get_loc(column)] += 1000.0
    before, after = matrix(hourly(frame), block_steps=100), matrix(hourly(changed), block_steps=100)
    window = slice(None, frame.index[at + 23])
    inputs = [c for c in before.columns if c != PRICE]
    pd.testing.assert_frame_equal(before.loc[window, inputs], after.loc[window, inputs])


def test_block_size_does_not_change_the_matrix(hourly):
    df = hourly(market(900, seed=3))
    pd.testing.assert_frame_equal(matrix(df, block_steps=150), matrix(df), rtol=1e-12)


def test_time_mode_equals_row_mode_on_a_dense_grid(hourly):
    df = hourly(market(500, seed=4))
    pd.testing.assert_frame_equal(matrix(df, lag_mode="time", block_steps=200), matrix(df), rtol=1e-12)


def test_row_lags_run_over_removed_rows(hourly):
    frame = market(400, seed=5)
    frame.iloc[100, 0] = 9999.0
    kept = cleaning.keep_price_range(hourly(frame))
    got = matrix(kept)
    clean = frame.drop(frame.index[100])
    assert got["price_lag_336h"].tolist() == clean[PRICE].shift(336).dropna().tolist()


def test_series_that_end_early_bound_the_matrix(hourly):
    """A fundamental that ends early is kept below the drop limit, filled for
    three hours, and used with a lag of 24: the last complete row lies 27 h later."""
    frame = market(800, seed=6)
    last = 700
    frame.iloc[last + 1:, frame.columns.get_loc("solar_mwh")] = np.nan
    got = matrix(cleaning.drop_sparse(hourly(frame)))
    assert "solar_mwh_lag24" in got.columns
    assert got.index.max() == frame.index[last] + pd.Timedelta(hours=27)


def test_sparse_columns_are_dropped(hourly):
    frame = market(100)
    frame.iloc[:51, frame.columns.get_loc("load_mwh")] = np.nan
    frame.iloc[:50, frame.columns.get_loc("solar_mwh")] = np.nan
    df = hourly(frame)
    decisions = {r["column"]: (r["missing_fraction"], r["dropped"]) for r in cleaning.sparse_columns(df).collect()}
    assert decisions["load_mwh"] == (0.51, True) and decisions["solar_mwh"] == (0.5, False)
    assert "load_mwh" not in cleaning.drop_sparse(df).columns


@pytest.mark.parametrize("block", [4, 8192])
def test_fill_reaches_three_rows(hourly, block):
    frame = pd.DataFrame({"v": [1.0, *[np.nan] * 5, 2.0, np.nan]}, index=pd.date_range("2024-01-01", periods=8, freq="h"))
    got = cleaning.forward_fill(hourly(frame), ["v"], block_steps=block).orderBy("utc_timestamp").toPandas()["v"]
    np.testing.assert_array_equal(got, frame["v"].ffill(limit=3))


def test_price_filter_drops_missing_prices(hourly):
    frame = pd.DataFrame({PRICE: [np.nan, -500.0, 3000.0, 3000.1]}, index=pd.date_range("2024-01-01", periods=4, freq="h"))
    assert cleaning.keep_price_range(hourly(frame)).count() == 2
