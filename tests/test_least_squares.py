"""Least squares from mergeable sums against numpy."""

import numpy as np
import pandas as pd
import pytest

from wattline.operators import least_squares
from wattline.operators.least_squares import forecast, ridge_fit, ridge_fold_predictions

INPUTS = ["a", "b", "c", "d", "e", "f"]


def frame(n=5000, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6)) * [1, 10, 100, 1, 5, 0.1] + [0, 50, 1000, 0, 3, 0]
    y = x @ [1, -2, 0.1, 5, 0, 20] + 7 + r.normal(size=n)
    return pd.DataFrame({**{c: x[:, i] for i, c in enumerate(INPUTS)}, "y": y}, index=pd.date_range("2024-01-01", periods=n, freq="h"))


def direct(x, y, penalty):
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + penalty * np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    return lambda z: y.mean() + (z - x.mean(axis=0)) @ w


@pytest.mark.parametrize("penalty", [0.0, 300.0])
def test_folds_against_numpy(hourly, penalty):
    data = frame()
    data.iloc[100:130, 2] = np.nan
    rows = hourly(data, "A").unionByName(hourly(frame(seed=4), "B"))
    got = ridge_fold_predictions(rows, INPUTS, "y", penalty=penalty, n_folds=3).toPandas()
    assert got.groupby("zone").fold.unique().map(sorted).tolist() == [[0, 1, 2]] * 2
    for zone, part in (("A", data.dropna()), ("B", frame(seed=4))):
        for fold, month in enumerate(sorted(part.index.to_period("M").unique())[-3:]):
            train, held = part[part.index.to_period("M") < month], part[part.index.to_period("M") == month]
            want = direct(train[INPUTS].to_numpy(), train.y.to_numpy(), penalty)(held[INPUTS].to_numpy())
            have = got[(got.zone == zone) & (got.fold == fold)].sort_values("utc_timestamp")
            np.testing.assert_allclose(have.y_pred, want, rtol=1e-8)
            np.testing.assert_allclose(have.y_true, held.y)


def test_fit_and_forecast_with_inputs_that_repeat(hourly):
    data = frame(800)
    data["b"] = data["a"]
    models, centres = ridge_fit(hourly(data), INPUTS, "y")
    rows = hourly(data).join(models, "zone").select("utc_timestamp", "y", forecast(INPUTS, "y", centres).alias("p")).toPandas().sort_values("utc_timestamp")
    x = np.column_stack((np.ones(800), data[INPUTS]))
    want = x @ np.linalg.lstsq(x, data.y.to_numpy(), rcond=None)[0]
    np.testing.assert_allclose(rows.p, want, rtol=1e-7)


def test_no_rows_and_constant_input(hourly):
    assert least_squares.solved(np.zeros((3, 3)), 1.0) is None
    data = frame(300)
    data["a"] = 5.0
    models, _ = ridge_fit(hourly(data), ["a"], "y")
    (row,) = models.collect()
    assert row["n_train"] == 300 and row["weights"][1] == 0
    assert ridge_fit(hourly(data).filter("false"), ["a"], "y")[0].count() == 0


def test_sums_are_read_in_one_pass(hourly):
    """The plan of the fold models reads the rows once and exchanges one row per month of a partition."""
    rows = hourly(frame(3000))
    centres = dict.fromkeys([*INPUTS, "y"], 0.0)
    folds = least_squares.fold_table(rows, 2, sums=least_squares.gram_sums(INPUTS, "y", centres))
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") + plan.count("LocalTableScan") == 1
