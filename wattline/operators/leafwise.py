"""Leaf-wise gradient boosting on histograms.

Inputs are cut into bins once. A tree grows best first: of all leaves the one whose best split gains most is split next,
until ``leaves`` are reached. A split needs, for each leaf, input and bin, the number of rows and the sum of
residuals; tasks count them for their rows, Spark adds them up, and only these sums (bounded by leaves, inputs and bins, not by
rows) reach the driver. The histogram of the larger of two children is their parent's less the smaller one's.

One pass serves many leaves: the order of splits is played through with what is known, every leaf whose children are needed for it
but unknown is asked for together, and this repeats until the order is settled. The tree is the one that
splitting leaf by leaf gives, with as many passes as it is deep. Residuals are whole multiples of a fixed
resolution, so sums, and with them trees, do not depend on partitions.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.session import settle

#: Most bins of an input, so that a bin fits into a byte.
MOST_BINS = 255


@dataclass(frozen=True)
class LeafwiseSettings:
    """``row_share`` of the rows and ``column_share`` of the inputs are drawn anew for each tree.

    ``resolution`` is the unit of residuals; by default it is as fine as exact sums of all rows allow. Scores are stored again
    after every ``stored_trees`` trees, so a pass evaluates at most that many.
    """

    iterations: int = 800
    step: float = 0.05
    leaves: int = 63
    min_leaf_rows: int = 20
    row_share: float = 0.8
    column_share: float = 0.8
    bins: int = MOST_BINS
    seed: int = 42
    resolution: float | None = None
    stored_trees: int = 20

    def estimator(self, target: str) -> LeafwiseRegressor:
        return LeafwiseRegressor(self, target)


@dataclass
class Tree:
    """Nodes in order of creation; a node with ``left`` below 0 is a leaf."""

    input: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, at: tuple[int, int], gain: float) -> tuple[int, int]:
        first = len(self.input)
        for name, default in (("input", 0), ("bin", 0), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0), ("rows", 0)):
            getattr(self, name).extend([default, default])
        self.input[node], self.bin[node] = at
        self.left[node], self.right[node], self.gain[node] = first, first + 1, gain
        return first, first + 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(v) for v in (self.input, self.bin, self.left, self.right, self.value))


def _places(arrays: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node that each row of ``bins`` ends in."""
    input_, cut, left, right, _ = arrays
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        rows = rows[left[node[rows]] >= 0]
        at = node[rows]
        node[rows] = np.where(bins[rows, input_[at]] <= cut[at], left[at], right[at])
    return node


def bin_edges(rows: DataFrame, inputs: str, n_inputs: int, bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each input (all but the last) over the array column ``inputs``.

    An input with at most ``bins`` different values has one bin for each, else bins between approximate quantiles. Missing values
    are left out here and lie in the first bin.
    """

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0)] * n_inputs
        for batch in batches:
            matrix = _matrix(batch.column(0), n_inputs)
            for i in range(n_inputs):
                if len(seen[i]) <= bins:
                    seen[i] = np.unique(np.concatenate((seen[i], matrix[:, i][~np.isnan(matrix[:, i])])))[: bins + 1]
        at = np.repeat(np.arange(n_inputs), [len(s) for s in seen])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate(seen))], names=["input", "value"])

    # A task names at most bins + 1 values of an input: more than bins in all tasks together means quantiles.
    named = rows.select(inputs).mapInArrow(different, "input int, value double").groupBy("input").agg(
        F.slice(F.array_sort(F.collect_set("value")), 1, bins + 1).alias("values")
    )
    few = {r["input"]: np.array(r["values"]) for r in named.collect()}
    many = [i for i in range(n_inputs) if len(few.get(i, ())) > bins]
    if many:
        cuts = [k / bins for k in range(1, bins)]
        sketches = [F.percentile_approx(F.get(inputs, F.lit(i)), cuts, 20 * bins).alias(f"q{i}") for i in many]
        row = rows.agg(*sketches).first()
        for i in many:
            few[i] = np.append(np.unique(np.array(row[f"q{i}"])), np.inf)
    return [few.get(i, np.zeros(0))[:-1] for i in range(n_inputs)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


def binned(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    found = np.zeros(matrix.shape, np.uint8)
    for i, ends in enumerate(edges):
        values = matrix[:, i]
        found[:, i] = np.where(np.isnan(values), 0, np.searchsorted(ends, values, side="left"))
    return found


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) from a row's hash and a seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x.astype(np.float64) / 2.0**64


class _Growth:
    """One fit: the stored rows (target, score, mark, bins) and the trees since scores were stored."""

    def __init__(self, settings: LeafwiseSettings, rows: DataFrame, n_inputs: int, resolution: float):
        self.settings, self.rows, self.n_inputs, self.resolution = settings, rows, n_inputs, resolution
        self.fresh: list[Tree] = []

    def histograms(self, tree: Tree, nodes: list[int], number: int) -> dict[int, np.ndarray]:
        """Rows and residual units of each of ``nodes`` by input and bin."""
        wide, cells = self.n_inputs, self.n_inputs * 256
        share, seed, resolution = self.settings.row_share, self.settings.seed * 1_000_003 + number, self.resolution
        earlier, arrays = [t.arrays() for t in self.fresh], tree.arrays()
        slot = np.full(len(tree.input), -1)
        slot[nodes] = np.arange(len(nodes))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((2, len(nodes) * cells), np.int64)
            offsets = np.arange(wide) * 256
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = _bins(batch.column(3), wide)
                residual = batch.column(0).to_numpy() - _scored(batch.column(1).to_numpy(), earlier, bins)
                mine = slot[_places(arrays, bins)]
                keep = mine >= 0
                if share < 1:
                    keep &= _mixed(batch.column(2).to_numpy().view(np.uint64), seed) < share
                at = (mine[keep][:, None] * cells + offsets[None, :] + bins[keep]).ravel()
                units = np.rint(residual[keep] / resolution)
                totals[0] += np.bincount(at, minlength=totals.shape[1])
                totals[1] += np.bincount(at, np.repeat(units, wide), totals.shape[1]).astype(np.int64)
            held = np.flatnonzero(totals[0])
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[0][held]), pa.array(totals[1][held])], names=["cell", "n", "units"])

        parts = self.rows.mapInArrow(count, "cell long, n long, units long")
        summed = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("units").alias("units")).toArrow()
        totals = np.zeros((2, len(nodes) * cells), np.int64)
        at = summed.column("cell").to_numpy()
        totals[0, at], totals[1, at] = summed.column("n").to_numpy(), summed.column("units").to_numpy()
        parted = totals.reshape(2, len(nodes), wide, 256)
        return {node: parted[:, i] for i, node in enumerate(nodes)}

    def best_split(self, held: np.ndarray, inputs: np.ndarray) -> tuple[float, int, int] | None:
        """Gain, input and bin of the best split; of equal gains the first input and then the lowest bin."""
        n, units = held[0].cumsum(axis=1), held[1].cumsum(axis=1)
        rows, total = n[0, -1], units[0, -1]
        least = max(self.settings.min_leaf_rows, 1)
        allowed = (n >= least) & (rows - n >= least) & (held[0] > 0) & inputs[:, None]
        if not allowed.any():
            return None
        left, right = units.astype(np.float64), (total - units).astype(np.float64)
        below, above = np.maximum(n, 1), np.maximum(rows - n, 1)
        gain = left * left / below + right * right / above - float(total) * float(total) / rows
        gain = np.where(allowed, gain, -np.inf)
        at = int(gain.argmax())
        best = float(gain.ravel()[at])
        return (best, *divmod(at, 256)) if best > 0 else None

    def grow(self, number: int) -> Tree:
        settings = self.settings
        rng = np.random.default_rng([settings.seed, number])
        inputs = np.zeros(self.n_inputs, bool)
        inputs[rng.permutation(self.n_inputs)[: max(1, math.ceil(settings.column_share * self.n_inputs))]] = True
        tree = Tree()
        held = {0: self.histograms(tree, [0], number)[0]}
        splits = {0: self.best_split(held[0], inputs)}
        while True:
            order, missing = self._order(tree, splits)
            if not missing:
                break
            asked, others = [], {}
            for node in missing:
                gain, input_, cut = splits[node]
                pair = tree.split(node, (input_, cut), gain)
                counts = held[node][0][input_]
                small, large = pair if 2 * counts[: cut + 1].sum() <= counts.sum() else pair[::-1]
                asked.append(small)
                others[small] = (node, large)
            for small, found in self.histograms(tree, asked, number).items():
                node, large = others[small]
                held[small], held[large] = found, held[node] - found
                for child in (small, large):
                    splits[child] = self.best_split(held[child], inputs)
        return self._pruned(tree, set(order), held)

    def _order(self, tree: Tree, splits: dict) -> tuple[list[int], list[int]]:
        """The nodes that best-first growth splits as far as known, and those of them whose children are not known yet."""
        queue = [(-splits[0][0], 0)] if splits[0] else []
        order, missing = [], []
        while queue and len(order) < self.settings.leaves - 1:
            _, node = heapq.heappop(queue)
            order.append(node)
            if tree.left[node] < 0:
                missing.append(node)
                continue
            for child in (tree.left[node], tree.right[node]):
                if splits[child]:
                    heapq.heappush(queue, (-splits[child][0], child))
        return order, missing

    def _pruned(self, tree: Tree, kept: set[int], held: dict[int, np.ndarray]) -> Tree:
        """The tree of the splits ``kept``, with leaf values; what was asked for in advance and not used goes."""
        final, todo = Tree(), [(0, 0)]
        while todo:
            old, new = todo.pop(0)
            n, units = int(held[old][0][0].sum()), int(held[old][1][0].sum())
            final.rows[new] = n
            final.value[new] = self.settings.step * self.resolution * units / n if n else 0.0
            if old in kept:
                pair = final.split(new, (tree.input[old], tree.bin[old]), tree.gain[old])
                todo += zip((tree.left[old], tree.right[old]), pair)
        return final

    def add(self, tree: Tree, last: bool) -> None:
        self.fresh.append(tree)
        if last or len(self.fresh) < self.settings.stored_trees:
            return
        wide, earlier = self.n_inputs, [t.arrays() for t in self.fresh]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = _scored(batch.column(1).to_numpy(), earlier, _bins(batch.column(3), wide))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), batch.column(2), batch.column(3)], names=batch.schema.names)

        self.rows = settle(self.rows.sparkSession, self.rows.mapInArrow(score, self.rows.schema), "scores")
        self.fresh = []


def _bins(column: pa.Array, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, wide)


def _scored(scores: np.ndarray, trees: list[tuple[np.ndarray, ...]], bins: np.ndarray) -> np.ndarray:
    scores = scores.copy()
    for arrays in trees:
        scores += arrays[4][_places(arrays, bins)]
    return scores


@dataclass
class Boosted:
    """A fitted ensemble over an array of inputs."""

    base: float
    edges: list[np.ndarray]
    trees: list[Tree]

    def score(self, matrix: np.ndarray) -> np.ndarray:
        bins = binned(matrix, self.edges)
        return _scored(np.full(len(bins), self.base), [t.arrays() for t in self.trees], bins)

    def importances(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of splits and summed gain of each input."""
        splits, gains = np.zeros(len(self.edges), np.int64), np.zeros(len(self.edges))
        for tree in self.trees:
            for input_, left, gain in zip(tree.input, tree.left, tree.gain):
                if left >= 0:
                    splits[input_] += 1
                    gains[input_] += gain
        return splits, gains


def boost(
    rows: DataFrame, target: str, inputs: str, settings: LeafwiseSettings, edges: list[np.ndarray] | None = None
) -> Boosted:
    """Fit to the array column ``inputs``; rows without target are left out. A table without rows gives the forecast 0.

    ``edges`` are the upper ends of the bins of each input, all but the last; see :func:`bin_edges`, which finds them by default.
    """
    spark = rows.sparkSession
    known = rows.select(F.col(target).cast("double").alias("target"), F.col(inputs).alias("inputs")).where("target is not null and not isnan(target)")
    known = settle(spark, known, "boosting-rows")
    facts = known.agg(
        F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean"), F.min("target").alias("low"), F.max("target").alias("high"), F.max(F.size("inputs")).alias("wide")
    ).first()
    if not facts["n"]:
        return Boosted(0.0, [], [])
    base, wide = facts["mean"], facts["wide"]
    edges = edges or bin_edges(known, "inputs", wide, min(settings.bins, MOST_BINS))
    reach = max(facts["high"] - facts["low"], 1e-300)
    # Residuals may grow while trees are added, so some bits stay free.
    bits = min(40, 58 - max(facts["n"], 2).bit_length())
    resolution = settings.resolution or 2.0 ** (math.ceil(math.log2(reach)) - bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned(_matrix(batch.column(1), wide), edges)
            rows_ = [bins[i].tobytes() for i in range(len(bins))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(bins), base)), batch.column(2), pa.array(rows_, pa.binary())], names=["target", "score", "mark", "bins"]
            )

    marked = known.withColumn("mark", F.xxhash64("target", "inputs"))
    stored = settle(spark, marked.mapInArrow(cut, "target double, score double, mark long, bins binary"), "bins")
    growth = _Growth(settings, stored, wide, resolution)
    trees = []
    for number in range(settings.iterations):
        trees.append(growth.grow(number))
        growth.add(trees[-1], number + 1 == settings.iterations)
    return Boosted(base, edges, trees)


class LeafwiseModel(Model, HasFeaturesCol, HasPredictionCol):
    """Adds the forecast to a table with the assembled inputs."""

    def __init__(self, boosted: Boosted, features: str = "_features", prediction: str = "y_pred"):
        super().__init__()
        self.boosted = boosted
        self._set(featuresCol=features, predictionCol=prediction)

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each input in the summed gain."""
        gains = self.boosted.importances()[1]
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    @property
    def splitCounts(self) -> DenseVector:
        return DenseVector(self.boosted.importances()[0].astype(float))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        boosted = self.boosted

        @F.pandas_udf("double")
        def forecast(features: pd.Series) -> pd.Series:
            if not len(features) or not boosted.edges:
                return pd.Series(np.full(len(features), boosted.base))
            return pd.Series(boosted.score(np.stack(features.to_numpy()).astype(np.float64)))

        return dataset.withColumn(self.getPredictionCol(), forecast(vector_to_array(F.col(self.getFeaturesCol()))))


class LeafwiseRegressor(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Leaf-wise boosting in the place of any Spark ML regressor."""

    def __init__(self, settings: LeafwiseSettings = LeafwiseSettings(), target: str = "label", features: str = "_features", prediction: str = "y_pred"):
        super().__init__()
        self.settings = settings
        self._set(labelCol=target, featuresCol=features, predictionCol=prediction)

    def _fit(self, dataset: DataFrame) -> LeafwiseModel:
        rows = dataset.select(F.col(self.getLabelCol()).alias("target"), vector_to_array(F.col(self.getFeaturesCol())).alias("inputs"))
        return LeafwiseModel(boost(rows, "target", "inputs", self.settings), self.getFeaturesCol(), self.getPredictionCol())


def tree_table(spark: SparkSession, trees: list[Tree], names: list[str]) -> DataFrame:
    """tree, node, input, bin, left, right, rows, value, gain: one row per node; input to right and gain are null for leaves."""
    rows = []
    for number, tree in enumerate(trees):
        for node in range(len(tree.input)):
            leaf = tree.left[node] < 0
            split = (None,) * 4 if leaf else (names[tree.input[node]], tree.bin[node], tree.left[node], tree.right[node])
            rows.append((number, node, *split, tree.rows[node], tree.value[node], None if leaf else tree.gain[node]))
    return spark.createDataFrame(rows, "tree int, node int, input string, bin int, left int, right int, rows long, value double, gain double")
