from datetime import date, datetime

import pandas as pd
from pyspark.sql import functions as F

from wattline.functions.numbers import nan_to_null
from wattline.operators import shaping


def points(spark, rows):
    return spark.createDataFrame(
        [(z, s, datetime.fromisoformat(t), v) for z, s, t, v in rows],
        "zone string, series string, utc_timestamp timestamp_ntz, value double",
    )


def test_empty_hour_is_null_for_prices_and_zero_for_energy(spark):
    raw = points(spark, [
        ("DE", "price_da_eur_mwh", "2024-01-01 00:15", 10.0), ("DE", "price_da_eur_mwh", "2024-01-01 00:45", 20.0),
        ("DE", "price_da_eur_mwh", "2024-01-01 02:00", 5.0),
        ("DE", "load_mwh", "2024-01-01 01:00", 1.0), ("DE", "load_mwh", "2024-01-01 01:15", 2.0),
        ("DE", "load_mwh", "2024-01-01 03:00", 4.0), ("DE", "solar_mwh", "2024-01-01 03:00", None),
    ])
    got = {(r["series"], r["utc_timestamp"].hour): r["value"] for r in shaping.resample_hourly(raw, how="rule").collect()}
    assert got == {
        ("price_da_eur_mwh", 0): 15.0, ("price_da_eur_mwh", 1): None, ("price_da_eur_mwh", 2): 5.0,
        ("load_mwh", 1): 3.0, ("load_mwh", 2): 0.0, ("load_mwh", 3): 4.0,
    }
    kept = shaping.resample_hourly(raw.filter("series = 'load_mwh'"), how="sum", empty_sum_zero=False)
    assert [r["value"] for r in kept.orderBy("utc_timestamp").collect()] == [3.0, None, 4.0]


def test_keep_first_chunk(spark):
    first = points(spark, [("DE", "a", "2024-01-01", 1.0)]).withColumn("chunk_no", F.lit(0))
    later = points(spark, [("DE", "a", "2024-01-01", 2.0), ("DE", "a", "2024-01-02", 3.0)]).withColumn("chunk_no", F.lit(1))
    got = shaping.union_keep_first([later, first]).orderBy("utc_timestamp").collect()
    assert [r["value"] for r in got] == [1.0, 3.0]


def test_year_chunks_cover_every_hour_once(spark):
    ranges = spark.createDataFrame(
        [("DE", datetime(2022, 3, 1, 5), datetime(2024, 1, 1, 0))], "zone string, s timestamp_ntz, e timestamp_ntz"
    )
    chunks = shaping.year_chunks(ranges, "s", "e").orderBy("year").collect()
    hours = pd.date_range("2022-03-01 05:00", "2024-01-01 00:00", freq="h")
    hit = [
        sum(c["chunk_start"] <= h and (h < c["chunk_end"] or (c["end_inclusive"] and h == c["chunk_end"])) for c in chunks)
        for h in hours
    ]
    assert set(hit) == {1}


def test_local_days_at_clock_changes(hourly):
    index = pd.date_range("2024-03-29", "2024-04-02", freq="h").union(pd.date_range("2024-10-25", "2024-10-29", freq="h"))
    fields = shaping.with_local_fields(hourly(pd.DataFrame({"v": 1.0}, index=index)))
    n = {r["local_date"]: r["count"] for r in fields.groupBy("local_date").count().collect()}
    assert n[date(2024, 3, 31)] == 23 and n[date(2024, 10, 27)] == 25 and n[date(2024, 3, 30)] == 24


def test_week_label_is_the_sunday(hourly):
    index = pd.date_range("2024-01-01", periods=14 * 24, freq="h")
    frame = pd.DataFrame({"v": range(len(index))}, index=index, dtype=float)
    got = shaping.weekly_mean(hourly(frame), {"v": F.col("v")}).orderBy("week_end").toPandas()
    want = frame["v"].resample("W").mean()
    assert got["week_end"].tolist() == want.index.tolist() and got["v"].tolist() == want.tolist()


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert [r["v"] for r in df.orderBy("v").collect()] == [None, 1.0]


def test_spine_starts_at_an_off_hour_timestamp(spark):
    ends = spark.createDataFrame(
        [("DE", datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 2, 2, 10))], "zone string, a timestamp_ntz, b timestamp_ntz"
    )
    got = [r["utc_timestamp"] for r in shaping.hour_spine(ends, ["zone"], "a", "b").orderBy("utc_timestamp").collect()]
    assert got == list(pd.date_range("2024-01-01 00:30", "2024-01-02 02:10", freq="h").to_pydatetime())
