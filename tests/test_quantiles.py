import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wattline.functions.quantiles import grouped_quantiles

WANTED = {"min": 0.0, "p01": 0.01, "half": 0.5, "p99": 0.99, "max": 1.0}


@pytest.mark.parametrize("whole_group", [20, 1000, 100_000])
def test_equal_numpy_on_skewed_groups(spark, whole_group):
    """The first group is far larger than the bound for ordering a group whole,
    and half of its values are the same."""
    rng = np.random.default_rng(0)
    groups = {
        "big": np.where(rng.random(20_000) < 0.5, 0.0, rng.lognormal(3, 2, 20_000)),
        "constant": np.full(900, 7.0),
        "small": rng.normal(size=11),
        "single": np.array([3.5]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", WANTED, whole_group=whole_group).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key]["n"] == len(values)
        for name, q in WANTED.items():
            assert got[key][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12), (key, name)


def test_values_that_repeat_do_not_stop_the_search(spark):
    """Ends and middle of the range repeat; few values lie between."""
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(3000), np.full(3000, 5.0), np.full(3000, 9.0), rng.uniform(0, 9, 1000)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    for q in (0.0, 0.299, 0.3003, 0.33, 0.35, 0.5, 0.66, 0.7001, 0.95, 1.0):
        got = grouped_quantiles(df, ["k"], "v", {"q": q}, whole_group=30).first()["q"]
        assert got == pytest.approx(np.quantile(values, q), rel=1e-12), q


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 2.5]) | st.floats(-1e6, 1e6), min_size=30, max_size=400), st.floats(0, 1))
def test_any_values(spark, values, q):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    got = grouped_quantiles(df, ["k"], "v", {"q": q}, whole_group=10).first()["q"]
    assert got == pytest.approx(np.quantile(values, q), rel=1e-9, abs=1e-9)


def test_brackets_keep_few_values(spark):
    from wattline.functions import quantiles

    df = spark.range(50_000).select(F.lit("a").alias("k"), F.rand(1).alias("_v"))
    whole = df.groupBy("k").agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    start = whole.select("k", "n", F.lit("p").alias("name"), (0.1 * (F.col("n") - 1)).alias("rank"), "low", "high")
    narrow = quantiles._narrow(df, ["k"], start).first()
    inside = df.filter(F.col("_v").between(narrow["low"], narrow["high"])).count()
    assert inside <= narrow["_held"] + 2 < 1000
