"""Ordered operators over a table that is stored in blocks."""

import numpy as np
import pandas as pd

from tests.test_leakage import market
from wattline.config import PRICE
from wattline.operators import features, validation
from wattline.operators.features import FeatureSpec
from wattline.plans import clustered


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_features_and_naive_without_an_exchange(spark, hourly):
    frame = market(900, seed=4)
    frame.iloc[40:45, 0] = np.nan
    rows = hourly(frame, "A").unionByName(hourly(market(700, seed=5), "B"))
    spec = FeatureSpec()
    name = clustered.store(rows, look_back=spec.look_back(), buckets=4, block_steps=200)
    laid = clustered.load(spark, name)
    got, want = features.matrix_of(laid, spec), features.feature_matrix(rows, spec, lag_mode="time")
    assert "Exchange" not in plan_of(got) and "Exchange" in plan_of(want)
    key = ["zone", "utc_timestamp"]
    pd.testing.assert_frame_equal(
        got.toPandas().sort_values(key).reset_index(drop=True), want.toPandas().sort_values(key).reset_index(drop=True)
    )
    naive = validation.naive_of(laid)
    assert "Exchange" not in plan_of(naive)
    wanted = validation.seasonal_naive(rows).select(*key, PRICE, "y_naive").toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(naive.select(*key, PRICE, "y_naive").toPandas().sort_values(key).reset_index(drop=True), wanted)
    spark.sql(f"drop table {name}")


def test_buckets_grow_with_the_rows(spark, hourly, monkeypatch):
    monkeypatch.setattr(clustered, "BUCKET_ROWS", 100)
    rows = hourly(market(700, seed=5), "A")
    name = clustered.store(rows, look_back=24, buckets=2, block_steps=200)
    described = {r.col_name: r.data_type for r in spark.sql(f"describe extended {name}").collect()}
    assert described["Num Buckets"] == "7" and clustered.load(spark, name).own_rows().count() == rows.count()
    spark.sql(f"drop table {name}")


def test_missing_hours_complete_the_spine(spark):
    from pyspark.sql import functions as F

    from wattline.operators.shaping import hour_spine, missing_hours

    bounds = spark.sql("select k, timestamp_ntz'2023-12-30 22:00:00' first, timestamp_ntz'2024-03-05 07:00:00' last from values (1), (2) as t(k)")
    spine = hour_spine(bounds, ["k"], "first", "last", "utc_timestamp")
    held = spine.where("k = 1 and hour(utc_timestamp) in (0, 7, 22)")
    free = missing_hours(bounds, held, ["k"], "first", "last")
    assert free.dtypes == spine.dtypes and "Cartesian" not in plan_of(free)
    assert sorted(free.collect()) == sorted(spine.exceptAll(held).collect())
    plan = plan_of(free.withColumn("x", F.lit(1)))
    assert plan.count("Generate") >= 1
