"""Every registered query against its SQL at sf0.01."""

import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.compare import compare, connect

SF = "/root/testdata/sf0.01"
#: Queries whose tables grow with the users; the driver and ``checks.compare`` run them at sf0.01.
SMALL, GROWING = "/root/testdata/sf0.001", ("_users", "_clustered")
ORACLE = catalog.ORACLE
ROWS_ONLY = {"gbt_forecast", "feature_importance"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql_but_the_listed_ones():
    assert set(catalog.QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    if name.endswith(GROWING):
        assert compare(entry.queries()[name](spark, SMALL), connect(SMALL), ORACLE[name]) is None
        return
    assert compare(entry.queries()[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_query_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_importances_rank_the_whole_feature_matrix(spark):
    from wattline.operators.features import CALENDAR

    ranked = [r["feature"] for r in entry.queries()["feature_importance"](spark, SF).collect()]
    lags = [f"y_lag_{k}d" for k in (7, 14, 21, 28, 56)]
    rolls = ["y_roll_7d_max", "y_roll_7d_min", "y_roll_7d_mean", "y_roll_28d_mean", "y_roll_28d_std"]
    assert sorted(ranked) == sorted([*CALENDAR, *lags, *rolls, "n_lag7", "n_lag28", "n_roll7_mean", "zone"])
