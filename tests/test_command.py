import json

import pandas as pd

from wattline.__main__ import main
from wattline.config import JobConfig


def test_settings_from_the_environment():
    config = JobConfig.from_env({"START_DATE": "2024-01-01", "FORCE_REFETCH": "TRUE"}, cv_folds=3)
    assert (config.start_date, config.end_date, config.force_refetch, config.cv_folds) == ("2024-01-01", "2025-12-31", True, 3)


def test_landed_files_to_signal(spark, tmp_path, monkeypatch):
    """Flat JSON chunks of two series, a rule document, and the whole run."""
    monkeypatch.setenv("START_DATE", "2024-01-01")
    monkeypatch.setenv("END_DATE", "2024-06-30")
    landing = tmp_path / "in"
    landing.mkdir()
    weeks = pd.date_range("2024-01-01", "2024-06-24", freq="7D")
    for series, scale in ((4169, 1.0), (4067, 300.0)):
        for week in weeks:
            hours = pd.date_range(week, periods=168, freq="h")
            rows = [[int(h.timestamp() * 1000), scale * (50 + 20 * (h.hour > 7) + 5 * h.dayofweek)] for h in hours]
            name = f"{series}_DE-LU_quarterhour_{int(week.timestamp() * 1000)}.json"
            (landing / name).write_text(json.dumps({"series": rows}))
    rules = tmp_path / "rules.json"
    rules.write_text('[{"name": "bounds", "column": "price_da_eur_mwh", "expression": "s between 0 and 500"}]')
    run = main(
        ["--landing", str(landing), "--output", str(tmp_path / "out"), "--rules", str(rules),
         "--folds", "1", "--test-months", "1", "--iterations", "3", "--lag-mode", "time"],
        spark)
    assert run.rule_results.first()["status"] == "pass"
    signal = run.signals.first()
    gap = signal["forecast_base_eur_mwh"] - signal["current_prompt_price_eur_mwh"]
    limit = signal["model_mae_threshold_eur_mwh"]
    assert signal["zone"] == "DE-LU"
    assert signal["direction"] == ("long" if gap > limit else "short" if gap < -limit else "neutral")
