from datetime import datetime

import numpy as np
import pandas as pd
import pytest

from wattline.operators import delivery, signal

# Hours of base, peak and off-peak in the published views of the
# window 2025-04-10 21:00 to 2025-07-10 20:00 UTC.
WINDOW = pd.date_range("2025-04-10 21:00", "2025-07-10 20:00", freq="h")
WEEK_HOURS = {
    "2025-W15": (99, 24, 75),
    **{f"2025-W{w}": (168, 60, 108) for w in range(16, 28)},
    "2025-W28": (69, 36, 33),
}
MONTH_HOURS = {"2025-04": (483, 168, 315), "2025-05": (744, 264, 480), "2025-06": (720, 252, 468), "2025-07": (237, 96, 141)}


@pytest.fixture
def forecast(hourly):
    values = 70 + 10 * np.sin(np.arange(len(WINDOW)) / 7)
    return hourly(pd.DataFrame({"y_pred": values, "y_pred_p10": values - 30, "y_pred_p90": values + 30}, index=WINDOW))


@pytest.mark.parametrize("horizon, wanted", [("week", WEEK_HOURS), ("month", MONTH_HOURS), ("year", WEEK_HOURS)])
def test_labels_and_hours_of_the_published_window(forecast, horizon, wanted):
    views = delivery.delivery_views(forecast, horizon).toPandas()
    got = {(r.period_label, r.product_type): r.n_hours for r in views.itertuples()}
    assert got == {(f"{label}-{p}", p): n for label, hours in wanted.items() for p, n in zip(delivery.PRODUCTS, hours)}


def test_first_and_last_week_boundaries(forecast):
    views = delivery.delivery_views(forecast).toPandas().set_index("period_label")
    assert views.loc["2025-W15-base", ["start", "end"]].tolist() == [
        pd.Timestamp("2025-04-10 21:00"), pd.Timestamp("2025-04-14 23:00")]
    assert views.loc["2025-W16-peak", ["start", "end"]].tolist() == [
        pd.Timestamp("2025-04-15 06:00"), pd.Timestamp("2025-04-21 17:00")]


def test_week_labels_over_year_ends(hourly):
    index = pd.date_range("2018-12-20", "2026-01-15", freq="D")
    got = delivery.delivery_views(
        hourly(pd.DataFrame({"y_pred": 1.0}, index=index)), "week", bounds=None).filter("product_type = 'base'").toPandas()
    frame = pd.Series(1.0, index=index)
    want = {k.strftime("%Y-W%W") + "-base" for k, g in frame.groupby(pd.Grouper(freq="W-MON")) if len(g) >= 2}
    assert set(got["period_label"]) == want


def test_base_is_the_weighted_mean_of_peak_and_offpeak(forecast):
    views = delivery.all_views(forecast).toPandas()
    views["stem"] = views["horizon"] + views["period_label"].str.rsplit("-", n=1).str[0]
    wide = views.pivot(index="stem", columns="product_type", values=["forecast_mean_eur_mwh", "n_hours"])
    mean, hours = wide["forecast_mean_eur_mwh"], wide["n_hours"]
    weighted = (mean["peak"] * hours["peak"] + mean["offpeak"] * hours["offpeak"]) / hours["base"]
    np.testing.assert_allclose(weighted.astype(float), mean["base"].astype(float))


def test_band_without_bounds_is_the_quantile(forecast):
    views = delivery.delivery_views(forecast, "month", bounds=None).toPandas().set_index("period_label")
    values = 70 + 10 * np.sin(np.arange(len(WINDOW)) / 7)
    june = values[(WINDOW.month == 6)]
    assert views.loc["2025-06-base", "forecast_p10"] == pytest.approx(np.percentile(june, 10))


def test_products_with_one_hour_are_left_out(hourly):
    index = pd.to_datetime(["2025-04-15 06:00", "2025-04-15 20:00", "2025-04-15 21:00"])
    views = delivery.delivery_views(hourly(pd.DataFrame({"y_pred": 1.0}, index=index)), "day", bounds=None)
    assert {r["product_type"] for r in views.collect()} == {"base", "offpeak"}


def test_daily_blocks_have_no_peak_at_weekends(forecast):
    blocks = delivery.daily_blocks(forecast).toPandas().set_index("date")
    saturday = pd.Timestamp("2025-04-12").date()
    assert pd.isna(blocks.loc[saturday, "peak_avg"]) and pd.isna(blocks.loc[saturday, "peak_spread"])
    monday = blocks.loc[pd.Timestamp("2025-04-14").date()]
    assert monday["peak_spread"] == pytest.approx(monday["peak_avg"] - monday["offpeak_avg"])


def view_rows(spark, base, peak=None, p10=31.4, p90=102.08, n=99):
    rows = [("DE", "week", "2025-W15-base", datetime(2025, 4, 10, 21), "base", base, p10, p90, n)]
    if peak is not None:
        rows.append(("DE", "week", "2025-W15-peak", datetime(2025, 4, 11, 6), "peak", peak, 31.57, 110.11, 24))
    schema = ("zone string, horizon string, period_label string, start timestamp_ntz, product_type string, "
              "forecast_mean_eur_mwh double, forecast_p10 double, forecast_p90 double, n_hours bigint")
    return spark.createDataFrame(rows, schema)


def test_published_signal(spark):
    references = spark.createDataFrame([("DE", 86.44, 720)], "zone string, reference_price double, n_reference bigint")
    mae = spark.createDataFrame([("DE", 18.81)], "zone string, mae double")
    record = signal.signal_record(signal.trading_signal(view_rows(spark, 69.67, 74.46), references, mae)).first()
    assert record["period"] == "2025-W15-base" and record["direction"] == "neutral"
    assert record["confidence_band"] == [31.4, 102.08] and record["band_width_eur_mwh"] == 70.68
    assert record["peak_spread"].asDict() == {"peak_vs_base_spread_eur_mwh": 4.79, "action": "hold"}
    assert record["reasoning"] == [
        "Forecast 69.7 within ±MAE of prompt 86.4 → no directional edge", "Peak/base spread forecast: 4.8 EUR/MWh → hold"]
    assert record["invalidation_conditions"][4].endswith("(38 EUR/MWh) → reduce position to 0")
    assert len(record["invalidation_conditions"]) == 5 and len(record["desk_actions"]) == 3


@pytest.mark.parametrize(
    "base, price, mae, peak, direction, action",
    [
        (100.0, 60.0, None, 106.0, "long", "buy peak vs base"),
        (100.0, 60.0, 40.0, 101.0, "neutral", "flatten shape"),
        (20.0, 60.0, None, None, "short", None),
        (100.0, None, None, 100.0, "neutral", "flatten shape"),
    ],
)
def test_signal_thresholds(spark, base, price, mae, peak, direction, action):
    references = spark.createDataFrame([("DE", price, 0)], "zone string, reference_price double, n_reference bigint")
    thresholds = spark.createDataFrame([("DE", mae, 10.0)], "zone string, mae double, train_mae double")
    got = signal.trading_signal(view_rows(spark, base, peak), references, thresholds).first()
    assert (got["direction"], got["peak_action"]) == (direction, action)
    assert got["mae_drift_stop"] is (mae is not None)
    assert got["model_mae_threshold_eur_mwh"] == (mae or 30.0)


def test_no_base_view_is_reported(spark):
    references = spark.createDataFrame([("DE", 1.0, 720)], "zone string, reference_price double, n_reference bigint")
    got = signal.signal_record(signal.trading_signal(view_rows(spark, 1.0).limit(0), references)).first()
    assert got["direction"] == "no_data" and got["reasoning"] == ["No base delivery views available"]


def test_full_periods_skip_the_partial_first_week(spark, forecast):
    references = spark.createDataFrame([("DE", 70.0, 720)], "zone string, reference_price double, n_reference bigint")
    views = delivery.all_views(forecast)
    assert signal.trading_signal(views, references).first()["period"] == "2025-W15-base"
    assert signal.trading_signal(views, references, full_periods_only=True).first()["period"] == "2025-W16-base"


@pytest.mark.parametrize("known, wanted", [(719, None), (720, 1.0), (900, 1.0)])
def test_reference_needs_all_its_hours(hourly, forecast, known, wanted):
    before = pd.date_range(end=WINDOW[0] - pd.Timedelta(hours=1), periods=known, freq="h")
    prices = pd.DataFrame({"p": [5.0] * max(known - 720, 0) + [1.0] * min(known, 720)}, index=before)
    prices = pd.concat([prices, pd.DataFrame({"p": 99.0}, index=WINDOW)])
    got = signal.prompt_reference(hourly(prices), forecast, price="p").first()
    assert got["reference_price"] == wanted


def test_product_table(forecast):
    base = delivery.by_product(delivery.all_views(forecast), "base")
    assert base.columns == ["zone", "period", "fair_value_eur_mwh", "p10_eur_mwh", "p90_eur_mwh", "hours"]
    assert base.count() == 18
    with pytest.raises(ValueError):
        delivery.by_product(forecast, "gas")
