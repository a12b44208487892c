"""Least squares with many inputs for every series and fold, from mergeable sums.

A month of a series is reduced to its Gram matrix, the sums of products of inputs and target, around rounded means that all
months share. Sums of months add up, so the training sums of a fold are running totals over months, and a
system of equations is solved for each (series, fold). Rows are read once for the sums and once to be forecast, whatever
the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from wattline.config import TS, ZONE
from wattline.functions.calendar import utc_floor
from wattline.operators.validation import fold_table
from wattline.plans.sizes import small_side


def _centres(rows: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Whole numbers near the means: products stay small without a loss of exactness."""
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: float(round(means[c] or 0.0)) for c in columns}


def gram_sums(inputs: Sequence[str], target: str, centres: dict[str, float]) -> dict[str, Column]:
    """Per-row terms whose sums make up the Gram matrix: ``_g<i>_<j>``, with place 0 for the constant and the last for the target."""
    values = [F.lit(1.0), *[F.col(c) - centres[c] for c in (*inputs, target)]]
    return {f"_g{i}_{j}": values[i] * values[j] for i in range(len(values)) for j in range(i, len(values))}


def solved(gram: np.ndarray, penalty: float) -> np.ndarray | None:
    """Intercept and weights that minimise the squared error plus ``penalty`` times the squared weights; None without rows.

    The intercept is not penalised. Inputs that the others determine share their weight evenly (the shortest solution).
    """
    n = gram[0, 0]
    if not n > 0:
        return None
    means = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(means, means)
    left = centred[:-1, :-1] + penalty * np.eye(len(means) - 1)
    scale = np.sqrt(np.maximum(np.diag(left), 0))
    scale[scale == 0] = 1
    weights = np.linalg.lstsq(left / np.outer(scale, scale), centred[:-1, -1] / scale, rcond=1e-12)[0] / scale
    return np.concatenate(([means[-1] - means[:-1] @ weights], weights))


def with_weights(sums: DataFrame, n_inputs: int, penalty: float) -> DataFrame:
    """``sums`` (one row per system) with ``weights``: intercept first, around the centres."""
    names = [f"_g{i}_{j}" for i in range(n_inputs + 2) for j in range(i, n_inputs + 2)]
    upper = np.triu_indices(n_inputs + 2)
    kept = [f for f in sums.schema.fields if f.name not in names]
    schema = StructType([*kept, StructField("weights", ArrayType(DoubleType()))])

    def solve(batches):
        for batch in batches:
            found = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            for row in range(batch.num_rows):
                gram = np.zeros((n_inputs + 2, n_inputs + 2))
                gram[upper] = [c[row] for c in columns]
                found.append(solved(gram + np.triu(gram, 1).T, penalty))
            held = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*held, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return sums.mapInArrow(solve, schema)


def forecast(inputs: Sequence[str], target: str, centres: dict[str, float], weights: str = "weights") -> Column:
    terms = [F.col(weights)[i + 1] * (F.col(c) - centres[c]) for i, c in enumerate(inputs)]
    return sum(terms, F.col(weights)[0] + centres[target])


def ridge_fit(
    rows: DataFrame, inputs: Sequence[str], target: str, *, penalty: float = 0.0, keys: Sequence[str] = (ZONE,)
) -> tuple[DataFrame, dict[str, float]]:
    """keys, n_train and ``weights`` of every series, and the centres that :func:`forecast` needs."""
    known = rows.dropna(subset=[*inputs, target])
    centres = _centres(known, [*inputs, target])
    sums = [F.sum(e).alias(n) for n, e in gram_sums(inputs, target, centres).items()]
    return with_weights(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), *sums), len(inputs), penalty), centres


def ridge_fold_predictions(
    rows: DataFrame,
    inputs: Sequence[str],
    target: str,
    *,
    penalty: float = 0.0,
    n_folds: int = 12,
    scale: float = 1.0,
    ts: str = TS,
    keys: Sequence[str] = (ZONE,),
    **fold_options,
) -> DataFrame:
    """keys, fold, time, y_true and y_pred of the validation rows of every fold; see ``validation.fold_table`` for the folds.

    Rows without an input or the target are left out. The table of folds has ``n_folds`` rows for a series; its size is checked before
    it is broadcast.
    """
    known = rows.dropna(subset=[*inputs, target])
    centres = _centres(known, [*inputs, target])
    folds = fold_table(known, n_folds, ts=ts, keys=keys, sums=gram_sums(inputs, target, centres), **fold_options)
    names = [f"_g{i}_{j}" for i in range(len(inputs) + 2) for j in range(i, len(inputs) + 2)]
    models = with_weights(folds.select(*keys, "fold", "val_month", *names), len(inputs), penalty)
    return (
        known.withColumn("val_month", utc_floor("month", ts))
        .join(small_side(models), [*keys, "val_month"])
        .select(
            *keys, "fold", ts, (F.col(target) / scale).alias("y_true"), (forecast(inputs, target, centres) / scale).alias("y_pred")
        )
    )
