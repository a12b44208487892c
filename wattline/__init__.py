"""Hourly energy-market analytics expressed as Spark DataFrame operators."""

from wattline.config import JobConfig
from wattline.session import build_session, prepare_session

__all__ = ["JobConfig", "build_session", "prepare_session"]
