import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from wattline.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def hourly(spark):
    """Builds (zone, utc_timestamp, value) rows from a pandas series or frame."""

    def build(frame, zone="DE"):
        flat = frame.rename_axis("utc_timestamp").reset_index()
        flat.insert(0, "zone", zone)
        flat["utc_timestamp"] = flat["utc_timestamp"].astype("datetime64[us]")
        measures = ", ".join(f"{c} double" for c in flat.columns[2:])
        from wattline.functions.numbers import nan_to_null

        return nan_to_null(
            spark.createDataFrame(flat, f"zone string, utc_timestamp timestamp_ntz, {measures}")
        )

    return build
