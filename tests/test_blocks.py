import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wattline.config import HOUR_MICROS
from wattline.plans.blocks import block_series, edge_rows, row_positions
from wattline.plans.sizes import small_side


def gappy(seed, n=700, start="1969-12-20"):
    rng = np.random.default_rng(seed)
    index = pd.date_range(start, periods=n, freq="h")
    keep = rng.random(n) > 0.2
    values = np.where(rng.random(n) > 0.1, rng.integers(0, 1000, n), np.nan).astype(float)
    return pd.Series(values, index=index, name="v")[keep].to_frame()


@pytest.mark.parametrize("block", [7, 50, 8192])
def test_row_windows_equal_pandas(hourly, block):
    frame = gappy(1)
    laid = block_series(hourly(frame), ["zone"], "utc_timestamp", look_back=60, block_steps=block)
    got = (
        laid.with_columns(
            {
                "lag5": laid.lag("v", 5),
                "mean": laid.full(F.avg("v"), "v", 12, 24),
                "std": laid.full(F.stddev_samp("v"), "v", 6, 0),
                "fill": laid.over(F.last("v", ignorenulls=True), 4),
            }
        )
        .own_rows()
        .toPandas()
        .sort_values("utc_timestamp")
    )
    assert len(got) == len(frame)
    v = frame["v"]
    for name, want in {
        "lag5": v.shift(5),
        "mean": v.shift(24).rolling(12).mean(),
        "std": v.rolling(6).std(),
        "fill": v.ffill(limit=3),
    }.items():
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("block", [10, 8192])
def test_time_windows_look_back_exact_hours(hourly, block):
    frame = gappy(2)
    laid = block_series(hourly(frame), ["zone"], "utc_timestamp", look_back=48, mode="time", block_steps=block)
    got = laid.with_columns({"lag": laid.lag("v", 48)}).own_rows().toPandas().set_index("utc_timestamp")["lag"]
    want = frame["v"].reindex(frame.index - pd.Timedelta(hours=48)).to_numpy()
    np.testing.assert_array_equal(got.reindex(frame.index).to_numpy(float), want)


def test_both_modes_agree_on_a_dense_grid(hourly):
    frame = gappy(3)[["v"]].asfreq("h")
    results = []
    for mode in ("row", "time"):
        laid = block_series(hourly(frame), ["zone"], "utc_timestamp", look_back=30, mode=mode, block_steps=64)
        out = laid.with_columns({"a": laid.lag("v", 24), "b": laid.full(F.max("v"), "v", 6, 24)}).own_rows()
        results.append(out.orderBy("utc_timestamp").toPandas())
    pd.testing.assert_frame_equal(*results)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000), span=st.integers(1, 200))
def test_positions_are_dense_in_time_order(hourly, seed, span):
    frame = gappy(seed, n=120)
    both = hourly(frame, "A").unionByName(hourly(frame.iloc[::2], "B"))
    got = row_positions(both, ["zone"], "utc_timestamp", span_micros=span * HOUR_MICROS).toPandas()
    for _, part in got.groupby("zone"):
        assert part.sort_values("utc_timestamp")["_pos"].tolist() == list(range(len(part)))


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("n", [1, 30, 10_000])
def test_edge_rows(hourly, last, n):
    frame = gappy(4)
    got = edge_rows(hourly(frame), ["zone"], "utc_timestamp", n, last=last, span_micros=40 * HOUR_MICROS)
    times = sorted(r["utc_timestamp"] for r in got.collect())
    want = frame.tail(n) if last else frame.head(n)
    assert times == list(want.index.to_pydatetime())


def test_small_side_is_broadcast_only_within_its_bound(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    side = spark.range(100).withColumnRenamed("id", "k").distinct()
    within = big.join(small_side(side, max_rows=100), "k")
    beyond = small_side(side, max_rows=99)
    assert "BroadcastHashJoin" in within._jdf.queryExecution().executedPlan().toString()
    assert "broadcast" not in beyond._jdf.queryExecution().logical().toString().lower()
    assert within.count() == big.join(beyond, "k").count() == 100
