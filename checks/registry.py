"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.session import prepare_session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Clients differ in how they show a date; its ISO text is the same in all."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _dates_as_text(build(prepare_session(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = prepared
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register
