"""All queries of this package."""

from wattline.llm import (  # noqa: F401
    queries_chat,
    queries_encoding,
    queries_language,
    queries_licenses,
    queries_lines,
    queries_lm,
    queries_near,
    queries_selection,
    queries_sharding,
    queries_vectors,
    queries_winnowing,
)
from wattline.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
