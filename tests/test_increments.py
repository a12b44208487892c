"""Incremental ingest against a build from all files."""

import json
import os

import pytest

from wattline.sources import increments, landing_json, landing_xml
from tests.test_landing import DOCUMENT

START, END = "2024-01-01", "2024-12-31"
DAY = 86_400_000


def base_ms():
    return landing_json.window_millis(START, END)[0]


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (1_700_000_000 + put.calls, 1_700_000_000 + put.calls))
    put.calls += 1


put.calls = 0


def land(folder, series, first_day, days, value, zone="DE", name=None):
    """One chunk file of hourly points over some days."""
    at = base_ms() + first_day * DAY
    points = [[at + h * 3_600_000, value + h % 7] for h in range(0, 24 * days, 5)]
    path = folder / f"{series}_{zone}_quarterhour_{at + (name or 0)}.json"
    put(path, json.dumps({"series": points}))
    return path


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def full(spark, folder):
    return rows(landing_json.market_table(spark, str(folder), START, END))


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "landing"
    land(folder, 4169, 0, 7, 50)
    land(folder, 4169, 7, 7, 60)
    land(folder, 4381, 25, 7, 900)
    land(folder, 4169, 100, 3, 10, zone="FR")
    return folder


def test_added_changed_repeated_and_vanished_files(spark, tmp_path, landed):
    root = str(tmp_path / "store")
    feed = increments.json_feed(str(landed), START, END)

    def step():
        manifest = increments.ingest(spark, feed, root)
        assert rows(increments.market(spark, root)) == full(spark, landed)
        return manifest

    first = step()
    assert first["version"] == 1 and sorted(first["points"]) == ["2024-01", "2024-02", "2024-04"]
    assert increments.ingest(spark, feed, root) == first  # nothing new: no version

    land(landed, 4169, 190, 2, 70)  # a later chunk: the price grid now spans the months between
    second = step()
    assert second["version"] == 2
    assert second["points"]["2024-01"] == first["points"]["2024-01"] and second["market"]["2024-03"] != first["market"].get("2024-03")

    land(landed, 4381, 25, 7, 901)  # changed content under the same name
    third = step()
    assert third["points"]["2024-07"] == second["points"]["2024-07"] and third["market"]["2024-07"] == second["market"]["2024-07"]
    assert third["points"]["2024-01"] != second["points"]["2024-01"]

    land(landed, 4381, 25, 7, 901, name=1)  # the same points once more
    step()
    land(landed, 4381, 40, 4, 5, name=2)
    put(landed / f"4066_DE_quarterhour_{base_ms()}.json", '{"series": [[1, 2')  # unreadable: no points, but known
    fifth = step()
    assert increments.ingest(spark, feed, root) == fifth

    (landed / f"4169_DE_quarterhour_{base_ms() + 190 * DAY}.json").unlink()  # the grid shrinks again
    sixth = step()
    assert "2024-07" not in sixth["market"] and "2024-07" not in sixth["points"]


def test_a_crash_before_the_switch_leaves_the_old_table(spark, tmp_path, landed, monkeypatch):
    root = str(tmp_path / "store")
    feed = increments.json_feed(str(landed), START, END)
    first = increments.ingest(spark, feed, root)
    before = rows(increments.market(spark, root))
    held = increments.market(spark, root)
    land(landed, 4169, 14, 7, 80)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(increments, "publish", crash)
        with pytest.raises(RuntimeError):
            increments.ingest(spark, feed, root)
    assert increments.current(spark, root) == first and rows(increments.market(spark, root)) == before
    assert increments.ingest(spark, feed, root)["version"] == 2
    assert rows(increments.market(spark, root)) == full(spark, landed) != before
    assert rows(held) == before  # a reader of the old version is not disturbed


def test_documents_keep_the_first(spark, tmp_path):
    landing, root = tmp_path / "xml", str(tmp_path / "store")
    place = landing / "doc_type=A44" / "psr_type=-" / "zone=07"
    put(place / "b.xml", DOCUMENT.format(day="2024-01-02", price=2))
    put(place / "c.xml", DOCUMENT.format(day="2024-03-05", price=3))
    feed = increments.xml_feed(str(landing), START, END)

    def check():
        increments.ingest(spark, feed, root)
        got = rows(increments.market(spark, root))
        assert got == rows(landing_xml.market_table(spark, str(landing), START, END))
        return {r[1].strftime("%m-%d"): r[2] for r in got if r[2] is not None}

    assert check() == {"01-02": 2.0, "03-05": 3.0}
    put(place / "a.xml", DOCUMENT.format(day="2024-01-02", price=1))  # an earlier document of the same day
    assert check() == {"01-02": 1.0, "03-05": 3.0}
    put(place / "a.xml", DOCUMENT.format(day="2024-01-04", price=4))
    assert check() == {"01-02": 2.0, "01-04": 4.0, "03-05": 3.0}


def test_nothing_landed_yet(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    with pytest.raises(ValueError, match="nothing"):
        increments.market(spark, str(tmp_path / "store"))
    feed = increments.json_feed(str(tmp_path / "landing"), START, END)
    increments.ingest(spark, feed, str(tmp_path / "store"))
    assert increments.market(spark, str(tmp_path / "store")).count() == 0
    land(tmp_path / "landing", 4169, 0, 2, 50)
    increments.ingest(spark, feed, str(tmp_path / "store"))
    assert rows(increments.market(spark, str(tmp_path / "store"))) == full(spark, tmp_path / "landing")
