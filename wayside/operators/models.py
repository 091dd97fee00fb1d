"""Models: ridge by normal equations in one pass, forests, Spark ML's logistic and Huber regression, fold-local training.

Only fitted parameters reach the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.operators import forests
from wayside.operators.folds import balanced_weights
from wayside.operators.rail import symmetric_design
from wayside.session import cut

# Model settings.
MOST_DEPTH, MOST_CLASSES = 30, 100  # the deepest tree and the most classes of Spark ML
TREES_A_FIT = 10
RIDGE_ALPHA, DOOR_TREES, RAIL_TREES, DOOR_LEAF, LOGISTIC_C = 1.0, 500, 800, 2, 1.0
RESPONSE_FEATURES = ("t_in", "t_out", "t_set_cool", "full_cool")
LOGISTIC_FEATURES = ("mid_mean", "trav_mean", "exc_mid_mean", "op_is_open")
HUBER_ALPHA, HUBER_EPSILON = 1.0, 1.35


@dataclass(frozen=True)
class Linear:
    features: tuple[str, ...]
    means: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def predict(self) -> Column:
        """Prediction; missing features count as their training mean."""
        terms = (F.coalesce(F.col(f).cast("double"), F.lit(m)) * c for f, m, c in zip(self.features, self.means, self.coefficients))
        return sum(terms, F.lit(self.intercept))


def fit_ridge(rows: DataFrame, features: Sequence[str], target: str, alpha: float = RIDGE_ALPHA) -> Linear:
    """Least squares with a squared penalty on the slopes, from centred cross-products gathered in one aggregation."""
    names = list(features)
    complete = rows.select(*[F.col(c).cast("double").alias(c) for c in [*names, target]]).dropna()
    columns = [*names, target]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = complete.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    if not sums["n"]:
        raise ValueError("no complete rows to fit on")
    k = len(columns)
    cross = np.zeros((k, k))
    for i, (a, b) in enumerate(pairs):
        x, y = columns.index(a), columns.index(b)
        cross[x, y] = cross[y, x] = sums[f"c{i}"] * sums["n"]
    slopes = np.linalg.solve(cross[:-1, :-1] + alpha * np.eye(k - 1), cross[:-1, -1])
    means = np.array([sums[f"m{i}"] for i in range(k)])
    return Linear(tuple(names), tuple(map(float, means[:-1])), tuple(map(float, slopes)), float(means[-1] - slopes @ means[:-1]))


def response_residual(rows: DataFrame, model: Linear, target: str = "dT_10", name: str = "resid") -> DataFrame:
    """Observed minus expected change, defined while cooling."""
    return rows.withColumn(name, F.when(F.col("cooling"), F.col(target) - model.predict()))


def _assembled(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep")


def _weighted(rows: DataFrame, label: str) -> DataFrame:
    """Rows with class-balanced weights; there is one weight per class, so the join is a broadcast of a few rows."""
    weights = balanced_weights(rows, label).select(label, "weight")
    return rows.join(F.broadcast(weights), label)


@dataclass(frozen=True)
class Tree:
    """One tree as text."""

    number: int
    nodes: forests.Nodes

    @property
    def toDebugString(self) -> str:
        n = self.nodes
        lines = [f"  {i}: " + (f"leaf {n.counts[i].tolist()}" if n.left[i] < 0 else f"feature {n.feature[i]}, cell <= {n.cell[i]}: {n.left[i]}, else {n.left[i] + 1}")
                 for i in range(len(n.left))]
        return "\n".join([f"Tree {self.number} with {len(n.left)} nodes", *lines])


@dataclass(frozen=True)
class Part:
    """The trees of a forest that are grown by one task, where it can hold all rows."""

    forest: Forest
    number: int
    column: str = "probability"

    @property
    def numbers(self) -> range:
        sizes = self.forest.sizes
        return range(sum(sizes[:self.number]), sum(sizes[:self.number + 1]))

    @property
    def getNumTrees(self) -> int:
        return self.forest.sizes[self.number]

    @property
    def trees(self) -> list[Tree]:
        """What tasks have grown of the trees, for a look at them; they come to the driver."""
        told = self.forest.grown.where(F.col("tree").isin(list(self.numbers)) & (F.col("root") >= 0)).orderBy("tree", "root").collect()
        return [Tree(r["tree"], forests.Nodes.read(r.asDict(), self.forest.plan.classes)) for r in told]

    def setProbabilityCol(self, name: str) -> Part:
        return replace(self, column=name)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Assembled rows with the mean probability of these trees."""
        return self.forest.scored(rows, [self.number]).withColumn(self.column, array_to_vector("votes")).drop("votes")


@dataclass(frozen=True)
class Forest:
    """Trees in a written table, read as one model: every tree has one vote."""

    assembler: VectorAssembler
    limits: list[np.ndarray]  # candidate thresholds of the features
    plan: forests.Plan
    sizes: tuple[int, ...]  # trees of the parts
    upper: list[forests.Top]
    grown: DataFrame

    @property
    def parts(self) -> tuple[Part, ...]:
        return tuple(Part(self, i) for i in range(len(self.sizes)))

    def scored(self, assembled: DataFrame, parts: Sequence[int]) -> DataFrame:
        """Rows with the mean shares of the classes, ``votes``. Rows are written with a number that their votes come back by."""
        own = {t: i for i in parts for t in self.parts[i].numbers}
        rows = cut(assembled.withColumn("_row", F.monotonically_increasing_id()))
        x = rows.select(F.col("_row").alias("id"), vector_to_array("features").alias("x"))
        found = forests.votes(x, self.limits, self.grown, self.plan, own, self.upper, rows.count())
        return rows.join(found.withColumnRenamed("id", "_row"), "_row").drop("_row")

    def transform(self, rows: DataFrame) -> DataFrame:
        """Rows with the mean ``probability`` of all trees and the likeliest class as ``prediction``."""
        told = self.scored(self.assembler.transform(rows), range(len(self.sizes)))
        likeliest = (F.array_position("votes", F.array_max("votes")) - 1).cast("double")
        return told.withColumn("probability", array_to_vector("votes")).withColumn("prediction", likeliest).drop("votes")

    @property
    def importances(self) -> np.ndarray:
        return forests.importances(self.grown)


def fit_forest(
    rows: DataFrame, features: Sequence[str], label: str, trees: int, leaf: int = 1, subset: str = "sqrt", seed: int = 0, depth: int = MOST_DEPTH
) -> Forest:
    """Random forest with balanced class weights. Trees grow until their leaves are pure or MOST_DEPTH deep.

    Spark ML grows a forest level by level, keeps counts of every node and cell, and gathers all nodes on the driver. Trees know
    nothing of each other: here a task gets the rows as cells of one byte and grows TREES_A_FIT trees to the end. Where rows are
    too many for a task, trees are grown on sums of all tasks' counts until their nodes are small enough. Trees go to a written table.
    """
    assembler = _assembled(features)
    weighted = assembler.transform(_weighted(rows, label)).select(vector_to_array("features").alias("x"), F.col(label).alias("y"), "weight")
    ready = cut(weighted.withColumn("id", F.monotonically_increasing_id()))
    odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    per = ready.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("w"), F.count(F.when(odd, 1)).alias("odd"))
    found = {r["y"]: r for r in per.collect()}  # one row per class
    if not found:
        raise ValueError("no rows to fit on")
    if any(r["odd"] for r in found.values()):
        raise ValueError("features to fit on must not be missing or infinite")
    if any(y != int(y) or not 0 <= y < MOST_CLASSES for y in found):
        raise ValueError(f"classes must be whole numbers from 0 to {MOST_CLASSES - 1}")
    n, classes = sum(r["n"] for r in found.values()), int(max(found)) + 1
    plan = forests.Plan(
        len(features), tuple(found[k]["w"] if k in found else 0.0 for k in range(classes)), leaf, forests.features_tried(subset, len(features), trees), depth, seed)
    limits = forests.thresholds(ready, len(features), n)
    packed = cut(forests.blocks(ready.withColumn("y", F.col("y").cast("int")), limits))
    fits = -(-trees // TREES_A_FIT)
    sizes = tuple(trees // fits + (i < trees % fits) for i in range(fits))
    upper = forests.tops(packed, plan, trees, n)
    return Forest(assembler, limits, plan, sizes, upper, forests.grown(packed, plan, sizes, upper))


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str, c: float = LOGISTIC_C) -> PipelineModel:
    """Standardised features, squared penalty of strength 1 / (C n), balanced weights."""
    weighted = _weighted(rows, label)
    stages = [
        _assembled(features, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(
            featuresCol="features", labelCol=label, weightCol="weight", regParam=1.0 / (c * max(weighted.count(), 1)), standardization=False)]
    return Pipeline(stages=stages).fit(weighted)


def probability(model: PipelineModel | Forest, rows: DataFrame, keep: Sequence[str], name: str = "p", cls: int = 1) -> DataFrame:
    """Probability of a class beside the ``keep`` columns."""
    scored = model.transform(rows)
    return scored.select(*keep, vector_to_array("probability")[cls].alias(name))


def ensemble(parts: Sequence[DataFrame], keys: Sequence[str], name: str = "p") -> DataFrame:
    """Mean of the probabilities of several models."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.avg(name).alias(name))


def importances(model: Forest, features: Sequence[str]) -> dict[str, float]:
    return dict(zip(features, map(float, model.importances)))


def fit_huber(rows: DataFrame, features: Sequence[str], target: str, alpha: float = HUBER_ALPHA, epsilon: float = HUBER_EPSILON) -> PipelineModel:
    n = max(rows.count(), 1)
    stages = [
        _assembled(features, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LinearRegression(
            featuresCol="features", labelCol=target, loss="huber", epsilon=epsilon, regParam=alpha / n, standardization=False,
            predictionCol="prediction", maxIter=200)]
    return Pipeline(stages=stages).fit(rows)


def residual_corrected(rows: DataFrame, model: PipelineModel, base: str, name: str = "corrected") -> DataFrame:
    """Physical estimate times exp of the learned log residual."""
    return model.transform(rows).withColumn(name, F.col(base) * F.exp("prediction"))


def out_of_fold(
    rows: DataFrame, fold: str, folds: Sequence[int], keep: Sequence[str],
    fit: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]],
) -> DataFrame:
    """Predictions for every unit from a model fitted without its fold.

    ``fit(train, fold)`` returns a function that scores held-out rows; whatever it learns (reference, scaler, model)
    it learns from the training rows only. The loop is over folds, each fit is distributed.
    """
    parts = []
    for k in folds:
        score = fit(rows.where(F.col(fold) != k), k)
        parts.append(score(rows.where(F.col(fold) == k)).select(*keep, F.lit(k).alias("fold"), "p"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def nested_out_of_fold(
    rows: DataFrame, outer: str, inner: str, outers: Sequence[int], inners: Sequence[int], keep: Sequence[str],
    fit: Callable[[DataFrame, int], Callable[[DataFrame], DataFrame]],
) -> DataFrame:
    """Out-of-fold predictions inside the training rows of every outer fold: column ``outer`` beside those of ``out_of_fold``.

    What is chosen from them (a threshold) has seen no row of the outer fold.
    """
    parts = [out_of_fold(rows.where(F.col(outer) != o), inner, inners, keep, fit).withColumn("outer", F.lit(o)) for o in outers]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def fit_hierarchical(rows: DataFrame, unit: str, features: Sequence[str], trees: int, seed: int = 0):
    """Detector on the symmetric design of a unit's two side rows, localiser on the rows of faulty units only.

    ``rows`` has unit, side, the features and ``label`` (Normal, Side I, Side II). With no faulty unit the localiser
    is the constant one half; with a single class the detector is that class.
    """
    names = list(features)
    pairs = symmetric_design(rows, [unit, "label"], names)
    design_names = [c for c in pairs.columns if c not in (unit, "label")]
    faulty = pairs.withColumn("y", (F.col("label") != "Normal").cast("double"))
    classes = {r["y"]: r["n"] for r in faulty.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    detector = fit_forest(faulty, design_names, "y", trees, seed=seed) if len(classes) == 2 else None
    constant = max(classes) if classes else 0.0
    own = (F.col("label") == F.when(F.col("side") == 1, "Side I").otherwise("Side II")).cast("double")
    localiser = None
    if 1.0 in classes:
        localiser = fit_forest(rows.where("label <> 'Normal'").withColumn("y", own), names, "y", trees, seed=seed + 1)

    def score(test: DataFrame) -> DataFrame:
        both = symmetric_design(test, [unit], names)
        found = probability(detector, both, [unit], "detector") if detector else both.select(unit, F.lit(float(constant)).alias("detector"))
        views = probability(localiser, test, [unit, "side"], "own") if localiser else test.select(unit, "side", F.lit(0.5).alias("own"))
        return views.withColumn("other", 1 - F.col("own")).join(found, unit)

    return score
