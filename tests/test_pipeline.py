import json

import numpy as np
import pandas as pd
import pytest

from wattline.config import JobConfig, LOAD, PRICE
from wattline.operators.rules import Rule
from wattline.plans import pipeline


def market(seed, months=9):
    """A strongly weekly price, so that a fitted model is better than a guess."""
    index = pd.date_range("2024-01-01", periods=months * 30 * 24, freq="h")
    rng = np.random.default_rng(seed)
    week = 60 + 25 * np.sin(2 * np.pi * index.hour / 24) - 15 * (index.dayofweek >= 5)
    frame = pd.DataFrame({PRICE: week + rng.normal(0, 4, len(index))}, index=index)
    frame["wind_onshore_mwh"] = rng.uniform(1000, 40_000, len(index))
    frame["wind_offshore_mwh"] = rng.uniform(100, 8000, len(index))
    frame["solar_mwh"] = np.clip(30_000 * np.sin(2 * np.pi * (index.hour - 6) / 24), 0, None)
    frame[LOAD] = np.nan
    frame.iloc[: len(index) // 4, frame.columns.get_loc(LOAD)] = 50_000.0
    return frame


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    from wattline.functions.numbers import nan_to_null

    output = str(tmp_path_factory.mktemp("run"))

    def build():
        parts = []
        for zone, seed in (("DE", 1), ("AT", 2)):
            flat = market(seed).rename_axis("utc_timestamp").reset_index()
            flat.insert(0, "zone", zone)
            flat["utc_timestamp"] = flat["utc_timestamp"].astype("datetime64[us]")
            measures = ", ".join(f"{c} double" for c in flat.columns[2:])
            parts.append(spark.createDataFrame(flat, f"zone string, utc_timestamp timestamp_ntz, {measures}"))
        return nan_to_null(parts[0].unionByName(parts[1]))

    config = JobConfig(cv_folds=2, test_months=2, gbt_iterations=4, gbt_depth=4)
    rules = [Rule("positive_load", LOAD, "s > 0"), Rule("price_jump", PRICE, "jump(150)")]
    return pipeline.run(spark, config, build, output, rule_list=rules), output, spark


def test_model_is_scored_beside_the_naive_forecast(done):
    run, _, _ = done
    rows = {r["zone"]: r for r in run.performance.collect()}
    assert set(rows) == {"DE", "AT"}
    for r in rows.values():
        assert r["baseline_n_scored"] == 168 and r["model_n_scored"] > 1000
        assert r["n_folds"] == 2 and 0.5 < r["coverage"] <= 1 and r["model_mae"] < 12


def test_sparse_load_is_dropped_and_recorded(done):
    run, output, spark = done
    decisions = {r["column"]: r["dropped"] for r in spark.read.json(f"{output}/column_decisions").collect()}
    assert decisions == {"wind_onshore_mwh": False, "wind_offshore_mwh": False, "solar_mwh": False, LOAD: True}
    names = {r["feature"] for r in run.importances.collect()}
    assert names and not any(LOAD in n for n in names)


def test_views_cover_the_forecast(done):
    run, output, spark = done
    hours = run.forecast.filter("zone = 'DE'").count()
    base = run.views.filter("zone = 'DE' and product_type = 'base'").toPandas()
    assert base.groupby("horizon")["n_hours"].sum().tolist() == [hours, hours]
    stored = spark.read.option("header", True).csv(f"{output}/forecast")
    assert stored.filter("zone = 'DE'").count() == hours
    assert stored.first()["id"].endswith("Z")


def test_signal_and_report_files(done):
    run, output, spark = done
    signals = spark.read.json(f"{output}/trading_signal").collect()
    assert {r["zone"] for r in signals} == {"DE", "AT"}
    assert all(r["current_prompt_price_eur_mwh"] is not None and r["direction"] in ("long", "short", "neutral") for r in signals)
    text = spark.read.text(f"{output}/quality_report").filter("zone = 'DE'").first()["value"]
    report = json.loads(text)
    assert report["verdict"] == [{"n_issues": 1, "passed": False}]
    assert report["issues"][0]["message"] == "load_mwh: 75.0% missing"
    assert report["rule_summary"][0]["n_pass"] == 1 and report["rule_summary"][0]["n_fail"] == 1
    assert report["model_performance"][0]["n_hours"] == run.forecast.filter("zone = 'DE'").count()


def test_figure_tables(done):
    run, _, _ = done
    assert run.figures["price_heatmap"].filter("zone = 'DE'").count() == 24
    assert run.figures["recent_folds"].select("fold").distinct().count() == 2
    assert run.figures["recent_comparison"].first()["n_common"] == 168
    assert run.figures["weekly_price_renewables"].columns == ["zone", "week_end", "price_mean", "wind_gwh", "solar_gwh"]
    assert run.figures["forecast_summary"].count() == 2
