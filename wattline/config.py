"""Column names, market constants and job settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

ZONE = "zone"
TS = "utc_timestamp"
PRICE = "price_da_eur_mwh"
MARKET_TZ = "Europe/Berlin"

# The four fundamentals and the accepted range of each series.
WIND = ("wind_onshore_mwh", "wind_offshore_mwh")
SOLAR = "solar_mwh"
LOAD = "load_mwh"
FUNDAMENTALS = (*WIND, SOLAR, LOAD)
DOMAIN_BOUNDS = {
    "price_da_eur_mwh": (-500.0, 3000.0),
    "wind_onshore_mwh": (0.0, 65000.0),
    "wind_offshore_mwh": (0.0, 10000.0),
    "solar_mwh": (0.0, 80000.0),
    "load_mwh": (10000.0, 90000.0),
}

# Numeric series ids of the JSON feed.
SERIES_IDS = {
    "price_da_eur_mwh": 4169,
    "wind_onshore_mwh": 4066,
    "wind_offshore_mwh": 4065,
    "solar_mwh": 4067,
    "load_mwh": 4381,
}

# Fixed values: (document type, production type) of the XML feed.
DOCUMENT_TYPES = {
    ("A44", "-"): "price_da_eur_mwh",
    ("A65", "-"): "load_mwh",
    ("A75", "B19"): "wind_onshore_mwh",
    ("A75", "B18"): "wind_offshore_mwh",
    ("A75", "B16"): "solar_mwh",
}

HOUR_MICROS = 3_600_000_000


@dataclass(frozen=True)
class JobConfig:  # fixed values: the defaults, and the environment names below
    """Settings of an end-to-end run; see ``plans.pipeline``."""

    start_date: str = "2022-01-01"
    end_date: str = "2025-12-31"
    random_seed: int = 42
    cv_folds: int = 12
    test_months: int = 3
    force_refetch: bool = False
    gbt_iterations: int = 800
    gbt_depth: int = 6
    learner: str = "depthwise"  # or "leafwise"
    parallel_fits: int = 4
    rules_last_n: int | None = None
    lag_mode: str = "row"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, **overrides) -> JobConfig:
        """Dates and the refetch flag from the environment."""
        found = {
            "start_date": env.get("START_DATE", cls.start_date),
            "end_date": env.get("END_DATE", cls.end_date),
            "force_refetch": env.get("FORCE_REFETCH", "false").lower() == "true",
        }
        return cls(**{**found, **overrides})
