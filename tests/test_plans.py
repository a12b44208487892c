"""Physical plans of the heavy operators."""

import re

import pytest
from pyspark.sql import functions as F

from checks.fixtures import ENERGY, points_long
from wattline.operators import delivery, features, quality, rules, shaping, validation

COLUMNS = ("price_c", *ENERGY)
SPEC = features.FeatureSpec(price="price_c", fundamentals=tuple(ENERGY), wind=("wind_onshore_c", "wind_offshore_c"), solar="solar_c")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A market table on disk; joins are not broadcast by their small size."""
    path = str(tmp_path_factory.mktemp("plans") / "market")
    measures = [F.rand(i).alias(c) for i, c in enumerate(COLUMNS)]
    hours = F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz")
    spark.range(2000).select(F.lit("DE").alias("zone"), hours.alias("utc_timestamp"), *measures).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def exchanges(text):
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|single)", text))


def test_no_python_and_no_single_task_window(stored):
    matrix = features.feature_matrix(stored, SPEC)
    text = plan(matrix)
    assert "Python" not in text and "SinglePartition" not in text
    assert "Window" in text and "_block" in text


def test_time_mode_shuffles_once(stored):
    text = plan(features.feature_matrix(stored, SPEC, lag_mode="time"))
    assert exchanges(text) == 1 and len(re.findall(r"\bSort \[", text)) == 1


def test_row_mode_adds_one_shuffle_of_rows_and_three_of_bucket_counts(stored):
    assert exchanges(plan(features.feature_matrix(stored, SPEC))) == 5


def test_time_slice_and_columns_reach_the_scan(stored):
    sliced = shaping.time_slice(stored, "1970-01-02 00:00:00", "1970-01-03 00:00:00").select("zone", "price_c")
    text = plan(sliced)
    assert "PushedFilters: [IsNotNull(utc_timestamp), GreaterThanOrEqual" in text.replace("In(", "")
    assert re.search(r"ReadSchema: struct<zone:string,utc_timestamp:timestamp_ntz,price_c:double>", text)


def test_resample_scans_points_once(spark):
    df = shaping.resample_hourly(points_long(spark, "/root/testdata/sf0.01"), how="mean", value="value_c")
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_statistics_and_row_rules_take_one_pass(stored):
    assert exchanges(plan(quality.column_stats(stored, COLUMNS))) == 1
    list_ = [rules.Rule(f"r{c}", c, "s > 0") for c in COLUMNS]
    text = plan(rules._count_rows(stored, [(i, r.column, r) for i, r in enumerate(list_)], "zone"))
    assert exchanges(text) == 1 and text.count("FileScan") == 1


def test_delivery_views_group_once(stored):
    forecast = stored.select("zone", "utc_timestamp", *[F.col("price_c").alias(c) for c in ("y_pred", "y_pred_p10", "y_pred_p90")])
    text = plan(delivery.delivery_views(forecast))
    assert exchanges(text) == 1 and "partial_avg" in text


def test_naive_needs_one_shuffle_and_no_join(stored):
    text = plan(validation.seasonal_naive(stored.select("zone", "utc_timestamp", "price_c"), target="price_c"))
    assert exchanges(text) == 1 and "Join" not in text


def test_folds_copy_no_training_rows(stored):
    text = plan(validation.fold_table(stored, 2))
    assert "Join" not in text and "partial_count" in text


def test_folds_open_only_their_months(spark, stored):
    from wattline.operators.learners import month_of
    from wattline.session import settle

    months = settle(spark, stored.withColumn("m", month_of("utc_timestamp")), "plan-months", partition_by=["m"])
    split = validation.holdout_split(months, 1).filter("part = 'train'")
    text = plan(split.filter(F.col("m") < F.lit("1970-02-01").cast("date")))
    assert re.search(r"PartitionFilters: \[isnotnull\(m#\d+\), \(m#\d+ < ", text)
