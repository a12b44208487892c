"""Leaf-wise boosting against a direct form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import leafwise
from wattline.operators.leafwise import LeafwiseSettings, bin_edges, boost
from wattline.operators.learners import PriceForecaster, walk_forward

PLAIN = dict(row_share=1.0, column_share=1.0, resolution=1 / 1024)


def direct_tree(bins, units, leaves, least):
    """Splits (input, bin, rows) in best-first order and the leaf of each row, one split after the other."""
    leaf, splits = np.zeros(len(bins), int), []
    while len(splits) < leaves - 1:
        best = None
        for k in range(len(splits) + 1):
            mine = leaf == k
            n, g = mine.sum(), float(units[mine].sum())
            for i in range(bins.shape[1]):
                for b in np.unique(bins[mine, i]):
                    low = mine & (bins[:, i] <= b)
                    nl, gl = low.sum(), float(units[low].sum())
                    if nl >= least and n - nl >= least:
                        gain = gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, k, i, int(b), int(n))
        if best is None:
            break
        _, k, i, b, n = best
        leaf[(leaf == k) & (bins[:, i] > b)] = len(splits) + 1
        splits.append((i, b, n))
    return splits, leaf


def table(spark, x, y):
    rows = [(float(t), [None if np.isnan(v) else float(v) for v in r]) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "y double, inputs array<double>").repartition(5)


@pytest.mark.parametrize("seed, leaves", [(0, 2), (1, 9), (2, 31)])
def test_trees_equal_split_by_split_growth(spark, seed, leaves):
    r = np.random.default_rng(seed)
    x = np.column_stack((r.integers(0, 6, 400), r.integers(0, 40, 400), r.integers(0, 2, 400))).astype(float)
    y = np.round(x[:, 0] * 3 + np.where(x[:, 1] > 20, 10, 0) + r.normal(size=400) * 4, 2)
    fitted = boost(table(spark, x, y), "y", "inputs", LeafwiseSettings(iterations=2, step=0.3, leaves=leaves, min_leaf_rows=10, **PLAIN))
    bins = leafwise.binned(x, fitted.edges)
    assert all((np.unique(bins[:, i]) == np.arange(len(np.unique(x[:, i])))).all() for i in range(3))
    score = np.full(400, y.mean())
    for tree in fitted.trees:
        units = np.rint((y - score) * 1024).astype(np.int64)
        splits, leaf = direct_tree(bins, units, leaves, 10)
        got = [(i, b, n) for i, b, n, left in zip(tree.input, tree.bin, tree.rows, tree.left) if left >= 0]
        assert sorted(got) == sorted(splits)
        values = np.array([0.3 / 1024 * units[leaf == k].sum() / (leaf == k).sum() for k in range(leaf.max() + 1)])
        np.testing.assert_allclose(leafwise._scored(np.zeros(400), [tree.arrays()], bins), values[leaf], rtol=1e-12)
        score = leafwise._scored(score, [tree.arrays()], bins)
    np.testing.assert_allclose(fitted.score(x), score)


def test_fit_does_not_depend_on_partitions(spark):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(300, 4)), r.normal(size=300)
    settings = LeafwiseSettings(iterations=5, leaves=8, bins=16, seed=3, stored_trees=2)
    one = boost(table(spark, x, y).coalesce(1), "y", "inputs", settings)
    two = boost(table(spark, x, y).repartition(7), "y", "inputs", settings)
    assert [t.arrays()[0].tolist() for t in one.trees] == [t.arrays()[0].tolist() for t in two.trees]
    np.testing.assert_allclose(one.score(x), two.score(x), rtol=1e-12)


def test_learns_and_ranks_inputs(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(2000, 5))
    y = 4 * np.sin(x[:, 1]) + (x[:, 3] > 0) * 3 + r.normal(size=2000) * 0.1
    fitted = boost(table(spark, x, y), "y", "inputs", LeafwiseSettings(iterations=30, step=0.2, leaves=12, bins=64))
    assert np.abs(fitted.score(x) - y).mean() < 0.35 < np.abs(y - y.mean()).mean() / 5
    splits, gains = fitted.importances()
    assert set(np.argsort(-gains)[:2]) == {1, 3} and splits.sum() == sum(len(t.input) // 2 for t in fitted.trees)
    assert all(sum(left < 0 for left in t.left) <= 12 for t in fitted.trees)
    rows = [t.rows[k] for t in fitted.trees for k in range(len(t.rows)) if t.left[k] < 0]
    assert min(rows) >= 20


def test_edges_of_few_and_many_values(spark):
    x = np.column_stack((np.arange(1000) % 7, np.arange(1000))).astype(float)
    x[5, 0] = np.nan
    few, many = bin_edges(table(spark, x, np.zeros(1000)), "inputs", 2, 20)
    assert few.tolist() == [0, 1, 2, 3, 4, 5]
    assert len(many) == 19 and np.abs(many - np.arange(50, 1000, 50)).max() <= 3
    assert leafwise.binned(np.array([[np.nan, -1.0]]), [few, many]).tolist() == [[0, 0]]


def test_degenerate_tables(spark):
    settings = LeafwiseSettings(iterations=2)
    assert boost(table(spark, np.zeros((0, 2)), []), "y", "inputs", settings).trees == []
    same = boost(table(spark, np.ones((50, 2)), np.full(50, 3.0)), "y", "inputs", settings)
    assert same.score(np.ones((2, 2))).tolist() == [3.0, 3.0] and all(len(t.input) == 1 for t in same.trees)


def test_takes_the_learner_slot(spark, hourly):
    index = pd.date_range("2024-01-01", periods=24 * 150, freq="h")
    frame = pd.DataFrame({"p": 50 + 20 * np.sin(index.hour / 24 * 2 * np.pi), "hour": index.hour.astype(float)}, index=index)
    rows = hourly(frame)
    settings = LeafwiseSettings(iterations=6, step=0.5, leaves=24)
    forecaster = PriceForecaster(("hour",), target="p", learner=settings.estimator)
    folds = walk_forward(rows, forecaster, 2)
    assert folds.agg(F.max(F.abs(F.col("y_true") - F.col("y_pred"))).alias("e")).first()["e"] < 2
    ranked = forecaster.fit(rows).importances().collect()
    assert [r["feature"] for r in ranked] == ["hour", "zone"] and ranked[0]["importance"] == 1.0
