import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wattline.operators import reports, validation
from wattline.operators.learners import GbtSettings, PriceForecaster, walk_forward


def series(days=500, seed=0, freq="6h"):
    index = pd.date_range("2022-01-01", periods=days * 4, freq=freq)
    rng = np.random.default_rng(seed)
    x = rng.normal(50, 10, len(index))
    return pd.DataFrame({"y": 3 + 2 * x + rng.normal(0, 5, len(index)), "x": x}, index=index)


def test_split_clamps_at_month_end(hourly):
    frame = pd.DataFrame({"y": 1.0}, index=pd.date_range("2024-02-20", "2024-05-31", freq="D"))
    split = validation.holdout_split(hourly(frame), 3)
    assert split.filter("part = 'train'").agg(F.max("utc_timestamp")).first()[0] == pd.Timestamp("2024-02-29")


def test_naive_sees_only_training_targets(hourly):
    index = pd.date_range("2024-01-01", periods=500, freq="h")
    df = hourly(pd.DataFrame({"y": np.arange(500.0)}, index=index)).withColumn(
        "part", F.when(F.col("y") < 100, "train").otherwise("test"))
    rows = validation.seasonal_naive(df, target="y", season=168, train_only=True, block_steps=50)
    test = rows.filter("part = 'test'").orderBy("utc_timestamp").toPandas()
    assert test["y_naive"].notna().sum() == 100
    assert (test["y"] - test["y_naive"]).dropna().eq(168).all()
    rolling = validation.seasonal_naive(df, target="y", season=168, block_steps=50)
    assert rolling.filter("y_naive is not null").count() == 332


def test_naive_needs_the_exact_hour(hourly):
    index = pd.date_range("2024-01-01", periods=400, freq="h").delete(5)
    rows = validation.seasonal_naive(hourly(pd.DataFrame({"y": np.arange(399.0)}, index=index)), target="y").toPandas()
    assert pd.isna(rows.set_index("utc_timestamp").loc[pd.Timestamp("2024-01-01 05:00") + pd.Timedelta(hours=168), "y_naive"])


def test_folds_train_on_earlier_months_only(hourly):
    df = hourly(series())
    folds = validation.fold_table(df, 5).orderBy("fold").toPandas()
    assert folds["fold"].tolist() == [0, 1, 2, 3, 4]
    assert (pd.to_datetime(folds["train_end"]) < pd.to_datetime(folds["val_month"])).all()
    months = series().index.to_period("M")
    for _, fold in folds.iterrows():
        month = pd.Period(fold["val_month"], "M")
        assert fold["n_train"] == (months < month).sum() and fold["n_val"] == (months == month).sum()


def test_too_few_months_stop_the_query_and_thin_folds_are_left_out(hourly):
    df = hourly(series(days=80))
    with pytest.raises(PySparkException, match="months are too few for 12 folds"):
        validation.fold_table(df, 12).collect()
    assert validation.fold_table(df, 12, on_short="skip").count() == 0
    thin = validation.fold_table(hourly(series(days=150)), 3, min_train_rows=300).toPandas()
    assert thin["fold"].tolist() == [1, 2]


def test_linear_folds_equal_least_squares(hourly):
    frame = series()
    df = hourly(frame)
    folds = validation.linear_folds(df, target="y", predictor="x", n_folds=4)
    months = frame.index.to_period("M")
    for r in folds.collect():
        before = frame[months < pd.Period(r["val_month"], "M")]
        slope, intercept = np.polyfit(before["x"], before["y"], 1)
        assert (r["slope"], r["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    predictions = validation.linear_fold_predictions(df, folds, target="y", predictor="x")
    metrics = validation.fold_metrics(predictions).orderBy("fold").toPandas()
    by_hand = predictions.toPandas()
    for _, m in metrics.iterrows():
        e = by_hand[by_hand["fold"] == m["fold"]].eval("y_true - y_pred")
        assert m["mae"] == pytest.approx(e.abs().mean())
        assert m["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
        assert m["pinball_10"] == pytest.approx(np.where(e >= 0, 0.1 * e, -0.9 * e).mean())
    summary = validation.cv_summary(validation.fold_metrics(predictions)).first()
    assert summary["mae_std"] == pytest.approx(metrics["mae"].std(ddof=0)) and summary["n_folds"] == 4
    assert reports.recent_folds(predictions, folds, n=2).select("fold").distinct().count() == 2


def test_interval_uses_hour_offsets_else_all_hours(spark, hourly):
    index = pd.date_range("2024-01-01", periods=24 * 11, freq="h")
    frame = pd.DataFrame({"y_true": index.hour.astype(float), "y_pred": 0.0}, index=index)
    frame = frame[(frame.index.hour != 3) | (frame.index.day <= 10)]
    bands = validation.residual_quantiles(hourly(frame))
    hours = sorted(r["local_hour"] for r in bands.collect())
    assert hours == [-1, *[h for h in range(24) if h != 4]]
    point = hourly(frame[["y_true", "y_pred"]].iloc[:24]).withColumn("fold", F.lit(0))
    banded = validation.prediction_interval(point, bands).toPandas().set_index("utc_timestamp").sort_index()
    overall = np.percentile(frame["y_true"] - frame["y_pred"], [10, 90])
    assert banded["y_pred_p10"].iloc[3] == pytest.approx(overall[0])
    assert banded["y_pred_p90"].iloc[5] == pytest.approx(5.0)
    cover = validation.interval_coverage(validation.prediction_interval(point, bands)).first()
    assert cover["n_hours"] == 24 and cover["coverage"] == 1.0


def test_comparison_counts_the_rows_behind_each_error(spark):
    rows = [("DE", 10.0, 8.0, 4.0), ("DE", 10.0, 13.0, None)]
    got = validation.compare_models(spark.createDataFrame(rows, "zone string, y_true double, y_pred double, y_naive double")).first()
    assert (got["baseline_mae"], got["baseline_n_scored"], got["model_mae"], got["model_n_scored"]) == (6.0, 1, 2.5, 2)
    assert got["improvement_pct"] == pytest.approx((1 - 2.5 / 6) * 100)
    assert got["common_improvement_pct"] == pytest.approx((1 - 2 / 6) * 100)


def test_boosted_trees_beat_the_mean_and_are_repeatable(hourly, spark):
    rng = np.random.default_rng(1)
    frame = series(days=170, seed=2)
    frame["noise"] = rng.normal(size=len(frame))
    df = hourly(frame).unionByName(hourly(frame + 1, "AT")).repartition(2).cache()
    make = lambda: PriceForecaster(("x", "noise"), target="y", learner=GbtSettings(iterations=5, depth=3).estimator)
    cv = walk_forward(df, make(), n_folds=2, parallel_fits=2)
    first, second = (c.orderBy("zone", "utc_timestamp").toPandas() for c in (cv, walk_forward(df, make(), n_folds=2)))
    pd.testing.assert_frame_equal(first, second)
    assert set(first["fold"]) == {0, 1} and len(first) == 2 * len(frame[frame.index >= "2022-05-01"])
    assert (first["y_true"] - first["y_pred"]).abs().mean() < 0.5 * (first["y_true"] - frame["y"].mean()).abs().mean()
    fitted = make().fit(df)
    top = fitted.importances().collect()
    assert top[0]["feature"] == "x" and len(top) == 3
    with pytest.raises(RuntimeError):
        make().predict(df)
    with pytest.raises(ValueError, match="too few"):
        walk_forward(df, make(), n_folds=12)


def test_recent_comparison_uses_common_rows(hourly):
    index = pd.date_range("2024-01-01", periods=20, freq="h")
    frame = pd.DataFrame({"y_true": 1.0, "y_pred": 0.0, "y_naive": 3.0}, index=index)
    frame.iloc[15:, 2] = np.nan
    got = reports.recent_comparison(hourly(frame), n=10).first()
    assert (got["n_common"], got["model_mae"], got["baseline_mae"]) == (10, 1.0, 2.0)
    assert got["last_hour"] == index[14].to_pydatetime()
