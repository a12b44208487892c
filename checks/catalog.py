"""All registered queries."""

from checks import boosting, delivery, features, quality, series, shaping, sources, users, validation  # noqa: F401
from checks.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
