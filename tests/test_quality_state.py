"""Quality tables from a state that months are added to."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import quality
from wattline.operators.quality_state import quality_state, tables_from_state, updated
from wattline.plans.pipeline import quality_tables
from wattline.session import settle

COLUMNS = ("price_da_eur_mwh", "load_mwh", "solar_mwh")


def rows(spark):
    r = np.random.default_rng(2)
    frames = []
    for zone, n in (("A", 2500), ("B", 900)):
        index = pd.date_range("2024-01-15 05:00", periods=n, freq="h")
        frame = pd.DataFrame({"zone": zone, "utc_timestamp": index, "price_da_eur_mwh": r.normal(50, 400, n), "load_mwh": np.where(r.random(n) < 0.2, np.nan, r.integers(0, 90000, n)), "solar_mwh": np.nan})
        keep = r.random(n) > 0.05
        frames += [frame[keep], frame[r.random(n) < 0.02]]
    full = pd.concat(frames).astype({"utc_timestamp": "datetime64[us]"})
    found = spark.createDataFrame(full, "zone string, utc_timestamp timestamp_ntz, price_da_eur_mwh double, load_mwh double, solar_mwh double")
    return found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in COLUMNS}).repartition(5)


def listed(frame):
    names = sorted(frame.columns)
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.select(*names).collect()), key=str
    ), names


@pytest.fixture(scope="module")
def wanted(spark):
    market = settle(spark, rows(spark), "market")
    tables = quality_tables(market, COLUMNS)
    tables["profile"] = quality.profile(quality.column_stats(market, COLUMNS))
    return market, {name: listed(t) for name, t in tables.items()}


def test_all_tables_in_one_go_and_month_by_month(spark, wanted):
    market, tables = wanted
    whole = settle(spark, quality_state(market, COLUMNS), "state")
    early = F.col("utc_timestamp") < F.lit("2024-03-01").cast("timestamp_ntz")
    # March was first seen with other rows, which the update replaces.
    wrong = market.filter(~early).limit(50).withColumn("load_mwh", F.lit(1.0))
    state = settle(spark, quality_state(market.filter(early).unionByName(wrong), COLUMNS), "state")
    state = settle(spark, updated(state, quality_state(market.filter(~early), COLUMNS)), "state")
    for held in (whole, state):
        got = tables_from_state(held, COLUMNS)
        assert set(got) == set(tables)
        for name, table in got.items():
            have, names = listed(table)
            want, wanted_names = tables[name]
            assert names == wanted_names and have == want, name


def test_one_scan(wanted):
    market, _ = wanted
    plan = quality_state(market, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_empty(spark, wanted):
    market, _ = wanted
    tables = tables_from_state(settle(spark, quality_state(market.filter("false"), COLUMNS), "state"), COLUMNS)
    assert all(t.count() == 0 for t in tables.values())
