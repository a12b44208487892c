"""Row filters, column selection and gap filling before features are built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattline.config import FUNDAMENTALS, PRICE, TS, ZONE
from wattline.functions.numbers import share
from wattline.plans.blocks import BLOCK_STEPS, BlockedSeries, block_series

PRICE_RANGE = (-500.0, 3000.0)
SPARSE_LIMIT = 0.50
FILL_LIMIT = 3


def keep_price_range(df: DataFrame, low: float = PRICE_RANGE[0], high: float = PRICE_RANGE[1], price: str = PRICE) -> DataFrame:
    """Rows whose price lies within the range; rows without a price go too."""
    return df.filter(F.col(price).between(low, high))


def sparse_columns(df: DataFrame, columns: Sequence[str] = FUNDAMENTALS, *, limit: float = SPARSE_LIMIT) -> DataFrame:
    """Null share of each present column over the whole table and whether it is dropped."""
    present = [c for c in columns if c in df.columns]
    cells = [
        F.struct(F.lit(c).alias("column"), share(F.col("_n") - F.col(f"_{c}"), F.col("_n")).alias("missing_fraction"))
        for c in present
    ]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_{c}") for c in present])
    dropped = F.col("missing_fraction") > limit
    return counts.select(F.col("_n").alias("n_rows"), F.inline(F.array(*cells))).select(
        "column",
        "n_rows",
        "missing_fraction",
        F.coalesce(dropped, F.lit(False)).alias("dropped"),
        F.when(dropped, F.lit(f"exceeds {limit:.0%} threshold")).alias("reason"),
    )


def drop_sparse(df: DataFrame, columns: Sequence[str] = FUNDAMENTALS, *, limit: float = SPARSE_LIMIT) -> DataFrame:
    """Drop the sparse columns. The schema depends on the data, so one small
    aggregate (one row per candidate column) runs here."""
    if not any(c in df.columns for c in columns):
        return df
    report = sparse_columns(df, columns, limit=limit)
    return df.drop(*[r["column"] for r in report.filter("dropped").collect()])


def fill_columns(laid: BlockedSeries, columns: Sequence[str], limit: int = FILL_LIMIT) -> BlockedSeries:
    """Carry the last value forward over at most ``limit`` positions."""
    filled = {c: laid.over(F.last(c, ignorenulls=True), limit + 1) for c in columns}
    return laid.with_columns(filled)


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    limit: int = FILL_LIMIT,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    mode: str = "row",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    laid = block_series(df, keys, ts, look_back=limit, mode=mode, block_steps=block_steps)
    return fill_columns(laid, columns, limit).own_rows()


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(columns))
