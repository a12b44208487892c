"""Boosted-tree forecasts on Spark ML with walk-forward validation.

One model is trained over the rows of all zones, with the zone as a categorical
input. Training is distributed by Spark ML.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.config import PRICE, TS, ZONE
from wattline.operators.validation import MIN_TRAIN_ROWS
from wattline.session import shared_folder


@dataclass(frozen=True)
class GbtSettings:
    iterations: int = 800
    step: float = 0.05
    depth: int = 6
    min_leaf_rows: int = 20
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    seed: int = 42

    def estimator(self, target: str) -> GBTRegressor:
        return GBTRegressor(
            labelCol=target,
            featuresCol="_features",
            predictionCol="y_pred",
            maxIter=self.iterations,
            stepSize=self.step,
            maxDepth=self.depth,
            minInstancesPerNode=self.min_leaf_rows,
            subsamplingRate=self.row_share,
            featureSubsetStrategy=str(self.column_share),
            maxBins=self.bins,
            seed=self.seed,
        )


@dataclass
class PriceForecaster:
    """Fits and applies one learner; any Spark ML regressor can take the slot.

    ``learner`` makes a fresh estimator reading ``_features`` and ``target`` and
    writing ``y_pred``.
    """

    inputs: tuple[str, ...]
    target: str = PRICE
    learner: Callable[[str], Estimator] = GbtSettings().estimator
    zone: str = ZONE
    ts: str = TS

    def __post_init__(self):
        self._model: PipelineModel | None = None
        self._zones: StringIndexerModel | None = None

    def index_zones(self, rows: DataFrame) -> PriceForecaster:
        """Learn the zone codes once; all folds share them."""
        indexer = StringIndexer(inputCol=self.zone, outputCol="_zone_code", handleInvalid="keep")
        self._zones = indexer.fit(rows.select(self.zone))
        return self

    def train(self, rows: DataFrame) -> PipelineModel:
        shared_folder(rows.sparkSession)
        if self._zones is None:
            self.index_zones(rows)
        estimator = self.learner(self.target)
        if estimator.hasParam("maxBins"):
            codes = len(self._zones.labels) + 1
            estimator.set(estimator.maxBins, max(estimator.getOrDefault("maxBins"), codes))
        assembler = VectorAssembler(inputCols=[*self.inputs, "_zone_code"], outputCol="_features")
        fitted = estimator.fit(assembler.transform(self._zones.transform(rows)))
        return PipelineModel([self._zones, assembler, fitted])

    def fit(self, rows: DataFrame) -> PriceForecaster:
        self._model = self.train(rows)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self._model is None:
            raise RuntimeError("fit the forecaster before predicting")
        return _apply(self._model, rows)

    def importances(self, top: int | None = None) -> DataFrame:
        """All inputs by falling importance, or the first ``top``."""
        if self._model is None:
            raise RuntimeError("fit the forecaster before reading importances")
        values = self._model.stages[-1].featureImportances.toArray().tolist()
        rows = [(name, float(value)) for name, value in zip([*self.inputs, self.zone], values)]
        ranked = SparkSession.active().createDataFrame(rows, "feature string, importance double")
        ranked = ranked.orderBy(F.desc("importance"), "feature")
        return ranked if top is None else ranked.limit(top)


def _apply(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).drop("_features", "_zone_code")


def month_of(ts: str) -> Column:
    """First day of the month: folds are cut by it, and tables may be stored by it."""
    return F.to_date(F.trunc(ts, "month"))


def walk_forward(
    rows: DataFrame,
    forecaster: PriceForecaster,
    n_folds: int = 12,
    *,
    min_train_rows: int = MIN_TRAIN_ROWS,
    parallel_fits: int = 4,
    month: str | None = None,
) -> DataFrame:
    """Validation rows of every fold: zone, fold, time, actual and forecast.

    Folds are calendar months of the whole table. Each fit reads its training
    months through a filter and no row is copied into folds. ``month`` names a
    column holding :func:`month_of`; for a table stored by that column, a fit
    opens only the folders of its months. Several fits are submitted at once.
    """
    ts = forecaster.ts
    held = F.col(month) if month else month_of(ts)
    counts = rows.groupBy(held.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    months = [(r["month"], r["n"]) for r in counts.orderBy("month").collect()]
    if len(months) < n_folds + 2:
        raise ValueError(f"{len(months)} months are too few for {n_folds} folds")
    forecaster.index_zones(rows)
    folds = []
    for fold, at in enumerate(range(len(months) - n_folds, len(months))):
        if sum(n for _, n in months[:at]) >= min_train_rows:
            folds.append((fold, months[at][0]))
    if not folds:
        raise ValueError("no fold has enough training rows")

    def one(fold_month) -> DataFrame:
        fold, first_day = fold_month
        model = forecaster.train(rows.filter(held < F.lit(first_day)))
        held_out = rows.filter(held == F.lit(first_day))
        return _apply(model, held_out).select(
            forecaster.zone,
            F.lit(fold).cast("bigint").alias("fold"),
            ts,
            F.col(forecaster.target).alias("y_true"),
            "y_pred",
        )

    with ThreadPoolExecutor(max_workers=max(1, parallel_fits)) as pool:
        parts = list(pool.map(one, folds))
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    return predictions
