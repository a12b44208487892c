"""Landed files: nothing is lost without a word."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline import session
from wattline.functions import quantiles
from wattline.sources import landing_json, landing_xml, tables

DOCUMENT = """<Doc xmlns="urn:x"><TimeSeries><Period><timeInterval><start>{day}T00:00Z</start><end>{day}T23:00Z</end></timeInterval>
<resolution>PT60M</resolution><Point><position>1</position><price.amount>{price}</price.amount></Point></Period></TimeSeries></Doc>"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_interleaved_documents_keep_every_hour(spark, tmp_path):
    place = tmp_path / "doc_type=A44" / "psr_type=-" / "zone=07"
    two = DOCUMENT.format(day="2024-01-01", price=1).replace("</TimeSeries>", "</TimeSeries>" + DOCUMENT.format(
        day="2024-01-03", price=3).split(">", 1)[1].replace("</Doc>", ""))
    put(place / "a.xml", two)
    put(place / "b.xml", DOCUMENT.format(day="2024-01-02", price=2))
    rows = landing_xml.market_table(spark, str(tmp_path), "2024-01-01", "2024-01-05").collect()
    got = {r["utc_timestamp"].day: r["price_da_eur_mwh"] for r in rows if r["price_da_eur_mwh"] is not None}
    assert got == {1: 1.0, 2: 2.0, 3: 3.0} and len(rows) == 49 and {r["zone"] for r in rows} == {"07"}


def test_xml_rejects(spark, tmp_path):
    base = tmp_path / "doc_type=A44" / "psr_type=-"
    put(base / "zone=A" / "good.xml", DOCUMENT.format(day="2024-01-01", price=1))
    put(base / "zone=A" / "cut.xml", DOCUMENT.format(day="2024-01-01", price=1)[:60])
    put(base / "zone=B" / "no.xml", "<Doc><Reason><code>999</code><text>nothing here</text></Reason></Doc>")
    put(tmp_path / "doc_type=X" / "psr_type=-" / "zone=A" / "odd.xml", DOCUMENT.format(day="2024-01-01", price=1))
    got = {r["file_name"]: r["reason"] for r in landing_xml.scan_rejects(spark, str(tmp_path)).collect()}
    assert got == {"cut.xml": "no readable series in the document", "no.xml": "nothing here", "odd.xml": "unknown document kind"}


@pytest.mark.parametrize("partitioned", [True, False])
def test_json_payloads_and_rejects(spark, tmp_path, partitioned):
    start = landing_json.window_millis("2024-01-01", "2024-01-02")[0]

    def place(series, name):
        if partitioned:
            return tmp_path / f"series_id={series}" / "zone=07" / f"chunk_ms={start}" / f"{name}.json"
        return tmp_path / f"{series}_07_quarterhour_{start + name}.json"

    put(place(4169, 0), '{\n  "series": [\n    [%d, 5.0],\n [%d, null]\n  ]\n}\n' % (start, start + 900_000))
    put(place(4066, 1), '{"series": [[%d, 5.0' % start)
    put(place(99, 2), '{"series": []}')
    put(place(4065, 3), '{"series": []}\n{"series": [[1, 2.0]]}')
    points = landing_json.scan_chunks(spark, str(tmp_path), "2024-01-01", "2024-01-02", partitioned=partitioned).collect()
    assert [(r["zone"], r["series"], r["value"]) for r in points] == [("07", "price_da_eur_mwh", 5.0)]
    got = {r["series_id"]: r["reason"] for r in landing_json.scan_rejects(spark, str(tmp_path), partitioned=partitioned).collect()}
    assert got == {4066: "payload not readable", 99: "unknown series", 4065: "payload not readable"}


def test_stored_market_keeps_zone_text_and_drops_nan(spark, tmp_path):
    rows = spark.createDataFrame(
        [("07", 1.0), ("10", float("nan"))], "zone string, price_da_eur_mwh double"
    ).withColumn("utc_timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    path = str(tmp_path / "market")
    stored = tables.load_or_build(spark, path, lambda: rows)
    assert sorted((r["zone"], r["price_da_eur_mwh"]) for r in stored.collect()) == [("07", 1.0), ("10", None)]
    (tmp_path / "market" / "_SUCCESS").unlink()
    again = tables.load_or_build(spark, path, lambda: rows.where("zone = '10'"))
    assert [r["zone"] for r in again.collect()] == ["10"]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_quantiles_agree_on_either_side_of_the_bound(spark):
    r = np.random.default_rng(3)
    rows = [("a", float(x)) for x in r.normal(size=997)] + [("b", float(x)) for x in r.integers(0, 9, 300) / 7]
    frame = spark.createDataFrame(rows, "k string, v double")
    wanted = {"q10": 0.1, "q37": 0.37, "q90": 0.9}
    whole, bracketed = (
        {r["k"]: tuple(r) for r in quantiles.grouped_quantiles(frame, ["k"], "v", wanted, whole_group=n).collect()} for n in (10**6, 50)
    )
    assert whole == bracketed
