"""Null handling and error measures on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing measures are NULL inside the library; NaN never enters it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def row_sum(*cols: str) -> Column:
    """Sum across columns in which a null counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, null for an empty whole."""
    return F.when(whole > 0, part / whole)


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    error = actual - predicted
    return F.when(error >= 0, F.lit(q) * error).otherwise(F.lit(q - 1.0) * error)
