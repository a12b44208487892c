import json
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.sources import landing_json, landing_xml, tables


def ms(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def land_json(folder, series_id, start, pairs, zone="DE-LU"):
    text = json.dumps({"series": [[ms(t), v] for t, v in pairs]}, indent=1)
    (folder / f"{series_id}_{zone}_quarterhour_{ms(start)}.json").write_text(text)


@pytest.fixture
def json_folder(tmp_path):
    quarter = [("2024-01-01 00:00", 10), ("2024-01-01 00:15", 20.5), ("2024-01-01 00:30", None), ("2024-01-01 02:00", 7)]
    land_json(tmp_path, 4169, "2024-01-01", quarter + [("2024-01-02 23:59", 1), ("2024-01-03 00:00", 99)])
    land_json(tmp_path, 4381, "2024-01-01", [("2023-12-31 23:45", 5), ("2024-01-01 00:00", 1), ("2024-01-01 00:45", 2), ("2024-01-01 02:15", 4)])
    land_json(tmp_path, 4381, "2023-12-01", [("2024-01-01 00:00", 1000)])
    land_json(tmp_path, 4381, "2024-02-01", [("2024-01-01 00:00", 1000)])
    land_json(tmp_path, 9999, "2024-01-01", quarter)
    return tmp_path


def test_json_points_inside_the_window(spark, json_folder):
    got = landing_json.scan_chunks(spark, str(json_folder), "2024-01-01", "2024-01-02")
    rows = {(r["zone"], r["series"], str(r["utc_timestamp"]), r["value"]) for r in got.collect()}
    assert rows == {
        ("DE-LU", "price_da_eur_mwh", "2024-01-01 00:00:00", 10.0), ("DE-LU", "price_da_eur_mwh", "2024-01-01 00:15:00", 20.5),
        ("DE-LU", "price_da_eur_mwh", "2024-01-01 02:00:00", 7.0), ("DE-LU", "price_da_eur_mwh", "2024-01-02 23:59:00", 1.0),
        ("DE-LU", "load_mwh", "2024-01-01 00:00:00", 1.0), ("DE-LU", "load_mwh", "2024-01-01 00:45:00", 2.0),
        ("DE-LU", "load_mwh", "2024-01-01 02:15:00", 4.0),
    }


def test_json_market_table(spark, json_folder):
    market = landing_json.market_table(spark, str(json_folder), "2024-01-01", "2024-01-01")
    assert market.columns == ["zone", "utc_timestamp", *landing_json.SERIES_IDS]
    got = market.orderBy("utc_timestamp").select("price_da_eur_mwh", "load_mwh", "solar_mwh").collect()
    assert [tuple(r) for r in got] == [(15.25, 3.0, None), (None, 0.0, None), (7.0, 4.0, None)]


def test_json_partition_folders_are_pruned(spark, tmp_path):
    rows = [([[float(ms("2024-01-01")), 1.0]], 4169, "DE", ms("2024-01-01")), ([[float(ms("2024-01-01")), 2.0]], 4169, "DE", ms("2023-01-01"))]
    frame = spark.createDataFrame(rows, "series array<array<double>>, series_id bigint, zone string, chunk_ms bigint")
    frame.write.partitionBy("series_id", "zone", "chunk_ms").json(str(tmp_path / "in"))
    got = landing_json.scan_chunks(spark, str(tmp_path / "in"), "2024-01-01", "2024-01-02", partitioned=True)
    assert [r["value"] for r in got.collect()] == [1.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_ms" in plan


def document(*series, root="Publication_MarketDocument"):
    return f'<?xml version="1.0"?><{root} xmlns="urn:iec62325.351:tc57wg16:451-3:publicationdocument:7:3">{"".join(series)}</{root}>'


def time_series(*periods):
    return f"<TimeSeries><mRID>1</mRID>{''.join(periods)}</TimeSeries>"


def period(start, resolution, *points):
    inner = "".join(
        f"<Point>{'' if p is None else f'<position>{p}</position>'}{'' if v is None else f'<{tag}>{v}</{tag}>'}</Point>"
        for p, tag, v in points)
    return f"<Period><timeInterval><start>{start}</start><end>x</end></timeInterval><resolution>{resolution}</resolution>{inner}</Period>"


@pytest.fixture
def xml_folder(tmp_path):
    def put(doc, psr, name, text, zone="DE_LU"):
        folder = tmp_path / f"doc_type={doc}" / f"psr_type={psr}" / f"zone={zone}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    price, quantity = "price.amount", "quantity"
    put("A44", "-", "2024.xml", document(
        time_series(period("2024-12-31T22:00Z", "PT60M", (1, price, 50.5), (2, price, 51))),
        time_series(
            period("2025-01-01T00:00Z", "PT30M", (None, price, 10), (2, price, 20), (3, price, None)),
            period("2025-01-01T02:00:00+01:00", "P1D", (1, price, 5), (2, price, 6)))))
    put("A44", "-", "2025.xml", document(time_series(period("2024-12-31T23:00Z", "PT60M", (1, price, 999)))))
    put("A75", "B16", "2024.xml", document(
        time_series(period("2024-12-31T23:00Z", "PT15M", (1, quantity, 4), (2, quantity, 8), (4, quantity, 0))), root="GL_MarketDocument"))
    put("A75", "B19", "none.xml", document("<Reason><code>999</code><text>No matching data found</text></Reason>", root="Acknowledgement_MarketDocument"))
    return str(tmp_path)


def test_xml_points(spark, xml_folder):
    rows = landing_xml.scan_documents(spark, xml_folder).filter("zone = 'DE_LU' and chunk_no = '2024.xml'").collect()
    got = {(r["series"], str(r["utc_timestamp"])): r["value"] for r in rows}
    assert got == {
        ("price_da_eur_mwh", "2024-12-31 22:00:00"): 50.5, ("price_da_eur_mwh", "2024-12-31 23:00:00"): 51.0,
        ("price_da_eur_mwh", "2025-01-01 00:00:00"): 10.0, ("price_da_eur_mwh", "2025-01-01 00:30:00"): 20.0,
        ("price_da_eur_mwh", "2025-01-01 01:00:00"): 5.0, ("price_da_eur_mwh", "2025-01-01 02:00:00"): 6.0,
        ("solar_mwh", "2024-12-31 23:00:00"): 4.0, ("solar_mwh", "2024-12-31 23:15:00"): 8.0, ("solar_mwh", "2024-12-31 23:45:00"): 0.0,
    }
    first = landing_xml.scan_documents(spark, xml_folder, first_period_only=True)
    assert first.filter("series = 'price_da_eur_mwh'").count() == 5


def test_xml_market_table_keeps_first_document_and_year_end(spark, xml_folder):
    market = landing_xml.market_table(spark, xml_folder, "2024-12-31", "2025-01-01").orderBy("utc_timestamp")
    got = [(str(r["utc_timestamp"]), r["price_da_eur_mwh"], r["solar_mwh"]) for r in market.collect()]
    assert got == [
        ("2024-12-31 22:00:00", 50.5, None), ("2024-12-31 23:00:00", 51.0, 4.0), ("2025-01-01 00:00:00", 15.0, None),
        ("2025-01-01 01:00:00", 5.0, None), ("2025-01-01 02:00:00", 6.0, None)]


def test_xml_rejections(spark, xml_folder):
    got = landing_xml.scan_rejections(spark, xml_folder).collect()
    assert [(r["doc_type"], r["psr_type"], r["text"]) for r in got] == [("A75", "B19", "No matching data found")]


def test_market_is_built_once_unless_forced(spark, hourly, tmp_path):
    calls = []

    def build(value):
        calls.append(value)
        return hourly(pd.DataFrame({"p": value}, index=pd.date_range("2023-12-31", periods=48, freq="h")))

    path = str(tmp_path / "market")
    for value, force, wanted in ((1.0, False, 1.0), (2.0, False, 1.0), (3.0, True, 3.0)):
        stored = tables.load_or_build(spark, path, lambda: build(value), force=force)
        assert stored.count() == 48 and {r["p"] for r in stored.collect()} == {wanted}
    assert calls == [1.0, 3.0]
    plan = stored.filter("zone = 'DE'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(zone" in plan


def test_report_has_one_document_per_zone(spark, tmp_path):
    a = spark.createDataFrame([("DE", 1, None), ("AT", 2, 0.5)], "zone string, n int, f double")
    b = spark.createDataFrame([("DE", "x"), ("DE", "y")], "zone string, c string")
    report = tables.report_json({"overview": a, "rows": b})
    got = {r["zone"]: json.loads(r["report"]) for r in report.collect()}
    assert got == {
        "DE": {"overview": [{"n": 1, "f": None}], "rows": [{"c": "x"}, {"c": "y"}]},
        "AT": {"overview": [{"n": 2, "f": 0.5}], "rows": []}}
    tables.write_report(report, str(tmp_path / "report"))
    back = spark.read.text(str(tmp_path / "report")).filter(F.col("zone") == "DE").first()["value"]
    assert json.loads(back) == got["DE"]
