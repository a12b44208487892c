"""Whitening of embeddings: exact covariance, eigenvectors refined in higher precision.

Whole-number sums make the covariance exact, whatever the partitions: tasks centre their vectors at the
rounded mean and add products as whole numbers, and the small rest of the mean is taken off
the totals. Eigenvectors come from a float32 solver and are corrected by the matrix-multiplication
iteration of Ogita and Aishima: the residuals ``R = I - X'X`` and ``S = X'AX`` give, for each pair of columns, the
first-order correction ``(S_ij + l_j R_ij) / (l_j - l_i)``, which doubles the number of right digits.
Columns whose eigenvalues are too near for that are made orthogonal only, and then turned by a sub-solve: the
problem of the cluster, shifted by its mean eigenvalue, has gaps that a small solver can tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.vectors import EXACT, grid_rows, matrix
from wattline.session import settle

#: The covariance of so many dimensions is held by the driver.
MOST_DIMENSIONS = 4096
_LONG = (1 << 63) - 1


def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(np.float64), 2))


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Numbers of the values that chains of neighbours nearer than ``width`` connect, for chains of two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def refined_eigen(a: np.ndarray, rounds: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision or better.

    Where eigenvalues coincide any orthonormal basis of their space is returned. The largest entry of each
    column is positive.
    """
    size = len(a)
    scale = np.abs(a).max(initial=0)
    if not size or scale == 0:
        return np.zeros(size, np.longdouble), np.eye(size, dtype=np.longdouble)
    a = a.astype(np.longdouble) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    whole, eye, before = _norm(a), np.eye(size, dtype=np.longdouble), np.inf
    # Eigenvalues nearer than the rounding of the products count as one; any basis of their space is right.
    noise = 64 * size * float(np.finfo(np.longdouble).eps) * whole
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        width = max(2 * (_norm(s - np.diag(values)) + whole * _norm(r)), noise)
        gaps = values[None, :] - values[:, None]
        near = np.abs(gaps) <= width
        change = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gaps))
        x = x + x @ change
        step = float(np.abs(change).max())
        turned = False
        for group in _clusters(values, width):
            part = x[:, group]
            shift = values[group].mean()
            small = part.T @ (a @ part - shift * part)
            small = (small + small.T) / 2
            spread = np.abs(small).max()
            if spread > noise:
                x[:, group] = part @ np.linalg.eigh((small / spread).astype(np.float64))[1].astype(np.longdouble)
                turned = True
        if step < 1e-17 or (not turned and step < 1e-6 and step > before / 2):
            break
        before = step
    x = x + x @ (eye - x.T @ x) / 2
    r = eye - x.T @ x
    values = np.diag(x.T @ a @ x) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(size)])
    return values[order] * scale, x * np.where(signs == 0, 1, signs)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``n`` vectors with sums ``sums``, and for each component its eigenvalue and vector."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    basis: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([_ratio(s, self.n) for s in self.sums]).astype(np.float64)

    def usable(self) -> np.ndarray:
        """Components with a variance that is more than rounding."""
        return np.asarray(self.values > 1e-14 * max(self.trace, 0.0) if self.trace else self.values * 0 > 1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        ok = self.usable()
        centred = (x.astype(np.longdouble) - np.array([_ratio(s, self.n) for s in self.sums])).astype(np.float64)
        roots = np.sqrt(np.where(ok, self.values.astype(np.float64), np.nan))
        return (centred @ self.basis.astype(np.float64)) / roots


def _ratio(part: int, whole: int) -> np.longdouble:
    """``part / whole`` of whole numbers of any size."""
    count, rest = divmod(part, whole)
    return np.longdouble(count) + np.longdouble(rest) / np.longdouble(whole)


def _upper(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size)


def _sum_rows(vectors: DataFrame, size: int, work) -> dict[int, int]:
    """Sums over all vectors of the whole numbers that ``work(x)`` returns for a batch, by their place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([int(v) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["at", "value"])

    parts = vectors.select("x").mapInArrow(partial, "at int, value decimal(38,0)")
    found = parts.groupBy("at").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()
    return {row["at"]: int(row["value"]) for row in found}


def _gram(x: np.ndarray, centre: np.ndarray, upper) -> np.ndarray:
    """Sums of the centred entries and of their products, as Python numbers."""
    y = x - centre
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        exact = y.astype(np.float64)
        products = (exact.T @ exact).astype(np.int64)
    else:
        whole = y.astype(object)
        products = whole.T @ whole
    return np.concatenate((y.astype(object).sum(axis=0), products[upper].astype(object)))


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Whitening fitted to ``vectors`` (x), each row counted once; None for an empty table.

    Two passes: sums, then centred products. Partial sums are one row per entry of the covariance and task.
    """
    one = vectors.select(F.size("x").alias("size")).first()
    if one is None:
        return None
    size = one["size"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions are more than {MOST_DIMENSIONS}")
    totals = _sum_rows(vectors, size, lambda x: np.concatenate(([len(x)], x.astype(object).sum(axis=0))))
    n, sums = totals[0], [totals[i + 1] for i in range(size)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = _upper(size)
    found = _sum_rows(vectors, size, lambda x: _gram(x, centre, upper))
    rest = [found[i] for i in range(size)]
    covariance = np.zeros((size, size), np.longdouble)
    for at, (i, j) in enumerate(zip(*upper)):
        covariance[i, j] = covariance[j, i] = _ratio(n * found[size + at] - rest[i] * rest[j], n * n)
    values, basis = refined_eigen(covariance)
    kept = min(components, size)
    return Whitening(n, sums, float(np.trace(covariance)), values[:kept], basis[:, :kept])


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened ``vectors`` minus the identity, over components with variance."""
    ok = np.flatnonzero(model.usable())
    if not len(ok):
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = model.project(matrix(batch.column(0)))[:, ok]
                values = np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    parts = vectors.select("x").mapInArrow(partial, "at int, value double")
    found = {r["at"]: r["value"] for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect()}
    k = len(ok)
    means = np.array([found[i] for i in range(k)]) / model.n
    second = np.array([found[k + i] for i in range(k * k)]).reshape(k, k) / model.n
    return float(np.abs(second - np.outer(means, means) - np.eye(k)).max())


def apply(vectors: DataFrame, model: Whitening, kind: str = "long") -> DataFrame:
    """vec_id, component, deviation, whitened for every row of ``vectors`` (vec_id, x) and component."""
    kept = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            whitened = model.project(x)
            far = model.n * int(np.abs(x).max()) + max(abs(s) for s in model.sums)
            number = np.int64 if far * far * x.shape[1] <= _LONG else object
            gaps = model.n * x.astype(number) - np.array(model.sums, dtype=number)
            deviation = [v if v <= _LONG else None for v in (gaps * gaps).sum(axis=1).tolist()]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), kept)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, kept + 1), len(x)), pa.int32()),
                    pa.array([d for d in deviation for _ in range(kept)], pa.int64()),
                    pa.array(whitened.ravel(), from_pandas=True),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, component int, deviation long, whitened double")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component.

    Rows with a null or empty vector, null or non-finite entries or another length than most take no part. Entries become whole
    numbers ``floor(256 * entry)``; the fit counts each different vector once, so copies, however many, weigh
    as one. ``deviation`` is the sum over dimensions of ``(n * x - S)^2``, null beyond a long. A component without
    variance (one vector, fewer vectors than components) has null ``whitened``; ``explained`` is null without any variance.
    Rows that repeat an id, or have none, are whitened like others; an empty table gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[id_col]
    vectors = settle(spark, grid_rows(rows, id_col, vector_col), "vectors")
    different = settle(spark, vectors.select("x").distinct(), "fit-list")
    model = fit(different, components)
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return spark.createDataFrame([], schema)
    error = identity_error(different, model)
    shares = [float(v / np.longdouble(model.trace)) if model.trace else None for v in model.values]
    share = F.array(*[F.lit(s).cast("double") for s in shares])[F.col("component") - 1]
    return apply(vectors, model, kind).select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
