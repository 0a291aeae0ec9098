"""Classifiers over ``row_id, label, features`` frames, fitted by pyspark.ml; trees over one task's rows by ``trees``.

Every fit returns an object with ``labels`` (sorted) and ``score(df)``, which adds ``probabilities`` in
the order of the labels and ``pred``.  Known gaps to other libraries: forests stop at depth 30 and know
no minimal split size, boosting grows level by level and has no L2 term.
"""

from __future__ import annotations

import json
import math
import pickle
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabfold.functions.numbers import argmax_label
from tabfold.models.trees import MOST_NODES, MOST_WORK, TooMuch, Trees, boosted, forest
from tabfold.operators.neighbors import k_nearest
from tabfold.operators.profiling import label_counts
from tabfold.operators.ranking import SEED, shuffle_key

MAX_CLASSES = 1000
ROWS_PER_TASK = 20_000
GROWN_ROWS = ROWS_PER_TASK  # frames of one task have their trees grown in it
MAX_FOREST_DEPTH = 30
DEFAULT_BOOST_DEPTH = 5  # about the 31 leaves of a leaf-wise learner
VALIDATION_SHARE = 16  # one row in so many, by hash, judges early stopping
BAG_SLICES = 256  # the bags of a forest draw equal rows in at most so many parts


def class_sizes(train: DataFrame) -> dict[Any, int]:
    """Rows per label, sorted by label; refuses a column that is no class label."""
    rows = label_counts(train, "label").orderBy("label").limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return {r["label"]: r["n"] for r in rows}


def _labels(labels: list) -> Column:
    return F.array(*[F.lit(v) for v in labels])


def equal_rows(rows: DataFrame, *more: Column | str) -> DataFrame:
    """``label, features`` and ``more`` of the distinct rows, with their number as ``_weight``."""
    return rows.groupBy("label", "features", *more).agg(F.count(F.lit(1)).cast("double").alias("_weight"))


def _slice(row_id: str) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(BAG_SLICES)).alias("_slice")


@contextmanager
def _coded(train: DataFrame, labels: list, *more: Column, each: bool = False):
    """Training frame with class codes, vectors and weights, and its rows; equal rows of equal ``more`` are one row unless ``each`` is set.

    Fits pass over it many times, and over few rows each pass costs more in tasks than in work, so a
    small frame gets few partitions; a large one keeps its own.
    """
    rows = train.select("label", "features", *more, F.lit(1.0).alias("_weight")) if each else equal_rows(train, *more)
    code = (F.array_position(_labels(labels), F.col("label")) - 1).cast("double")
    coded = rows.withColumn("_code", code).withColumn("_vector", array_to_vector("features")).drop("label", "features").persist()
    try:
        rows = coded.count()
        yield coded.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK))), rows
    finally:
        coded.unpersist()


def _grown(coded: DataFrame, rows: int, grow: Callable[..., list[tuple[Trees, np.ndarray]]]) -> list[tuple[Trees, np.ndarray]] | None:
    """Trees that ``grow`` makes of ``features, codes, weights, held_out`` in one task.

    Null where the frame is more than one task's, has gaps, or asks too much of a task; pyspark.ml fits those.
    """
    if not 0 < rows <= GROWN_ROWS:
        return None
    held = [c for c in coded.columns if c == "_held_out"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        features = np.array(table.column("features").to_pylist(), np.float64)
        codes, weights = table.column("_code").to_numpy().astype(np.int64), table.column("_weight").to_numpy()
        held_out = table.column("_held_out").to_numpy().astype(bool) if held else None
        if features.ndim < 2 or features.shape[1] == 0 or np.isnan(features).any():
            return
        # an order of its own, so that sums and bags do not follow the partitions
        order = np.lexsort([weights, *([held_out] if held else []), codes, *features.T])
        try:
            made = grow(features[order], codes[order], weights[order], held_out[order] if held else None)
        except TooMuch:
            return
        if sum(len(t.feature) for t, _ in made) <= MOST_NODES:
            # plain arrays: the class may be unknown by name where this runs
            plain = [((t.borders, t.roots, t.feature, t.cut, t.left, t.value), w) for t, w in made]
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(plain)], pa.binary())})

    one = coded.select(vector_to_array("_vector").alias("features"), "_code", "_weight", *held).coalesce(1)
    found = one.mapInArrow(task, "model binary").collect()
    return [(Trees(*parts), w) for parts, w in pickle.loads(found[0]["model"])] if found else None


@dataclass
class ConstantModel:
    """All training rows share one label."""

    labels: list

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probabilities", F.array(F.lit(1.0))).withColumn("pred", F.lit(self.labels[0]))


@dataclass
class VectorModel:
    """One pyspark.ml model that knows all classes."""

    labels: list
    model: Any

    def score(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df.withColumn("_vector", array_to_vector("features")))
        scored = scored.withColumn("probabilities", vector_to_array("_probability"))
        return scored.withColumn("pred", argmax_label(F.col("probabilities"), _labels(self.labels))).select(
            *df.columns, "probabilities", "pred"
        )


@dataclass
class OneVsRestModel:
    """One binary model per class; for two classes a single one, for the larger label."""

    labels: list
    models: list = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("_vector", array_to_vector("features"))
        shares = []
        for i, model in enumerate(self.models):
            model = model.copy({model.rawPredictionCol: f"_r{i}", model.probabilityCol: f"_p{i}", model.predictionCol: f"_c{i}"})
            scored = model.transform(scored)
            shares.append(vector_to_array(f"_p{i}")[1])
        if len(self.labels) == 2:
            shares = [1 - shares[0], shares[0]]
        total = sum(shares[1:], shares[0])
        scored = scored.withColumn("probabilities", F.array(*[F.when(total > 0, s / total).otherwise(1.0 / len(shares)) for s in shares]))
        return scored.withColumn("pred", argmax_label(F.col("probabilities"), _labels(self.labels))).select(
            *df.columns, "probabilities", "pred"
        )


@dataclass
class TreesModel:
    """Trees grown in one task: a forest, or boosted ones for each class (a single ensemble for two)."""

    labels: list
    ensembles: list[tuple[Trees, np.ndarray]]
    boosted: bool

    def score(self, df: DataFrame) -> DataFrame:
        ensembles, two, logistic = self.ensembles, len(self.labels) == 2, self.boosted

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def shares(rows: pa.Array) -> pa.Array:
            if len(rows) == 0:
                return pa.array([], pa.list_(pa.float64()))
            features = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            sums = np.concatenate([trees.sums(features, weights) for trees, weights in ensembles], 1)
            if logistic:
                sums = 1 / (1 + np.exp(-2 * np.clip(sums, -350, 350)))
                sums = np.concatenate([1 - sums, sums], 1) if two else sums
            total = sums.sum(1, keepdims=True)
            sums = np.where(total > 0, sums / np.where(total > 0, total, 1.0), 1.0 / sums.shape[1])
            return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * sums.shape[1], sums.reshape(-1))

        # by way of a vector, which refuses gaps as pyspark.ml does
        scored = df.withColumn("probabilities", shares(vector_to_array(array_to_vector("features"))))
        return scored.withColumn("pred", argmax_label(F.col("probabilities"), _labels(self.labels)))


@dataclass
class NeighborModel:
    """Nearest neighbours: nothing to fit, the training rows are searched."""

    labels: list
    train: DataFrame
    k: int
    weights: str

    def score(self, df: DataFrame) -> DataFrame:
        found = k_nearest(
            df, self.train, self.k, test_id="row_id", train_id="row_id", payload="label"
        )
        return df.join(
            neighbor_probabilities(found, self.labels, self.weights).withColumnRenamed("test_id", "row_id"),
            "row_id",
        )


def neighbor_probabilities(found: DataFrame, labels: list, weights: str) -> DataFrame:
    """Vote shares per class; at most k neighbours are gathered per row."""
    if weights == "distance":
        packed = F.collect_list(F.struct("dist", "payload"))
        nearest = F.array_min(F.transform("n", lambda e: e["dist"]))
        vote = lambda e: F.when(nearest == 0, (e["dist"] == 0).cast("double")).otherwise(1 / e["dist"])
    else:
        packed = F.collect_list(F.struct("dist", "payload"))
        vote = lambda e: F.lit(1.0)
    lists = found.groupBy("test_id").agg(F.array_sort(packed).alias("n"))
    sums = F.transform(
        _labels(labels),
        lambda c: F.aggregate(
            F.filter("n", lambda e: e["payload"] == c), F.lit(0.0), lambda a, e: a + vote(e)
        ),
    )
    sums = lists.select("test_id", sums.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    shares = sums.select("test_id", F.transform("s", lambda x: x / total).alias("probabilities"))
    return shares.withColumn("pred", argmax_label(F.col("probabilities"), _labels(labels)))


def fit_logistic(
    train: DataFrame, *, C: float = 1.0, max_iter: int = 1000, class_weight: str | None = None
):
    """L2 logistic regression with penalty strength 1/C, on the features as given.

    pyspark.ml averages the loss where C weighs its sum, hence the division by the row count.
    """
    sizes = class_sizes(train)
    labels = list(sizes)
    if len(labels) == 1:
        return ConstantModel(labels)
    n = sum(sizes.values())
    estimator = LogisticRegression(
        featuresCol="_vector", labelCol="_code", probabilityCol="_probability", weightCol="_weight", maxIter=max_iter,
        regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, tol=1e-6,
    )
    with _coded(train, labels) as (coded, _):
        if class_weight == "balanced":
            weights = F.array(*[F.lit(n / (len(labels) * sizes[v])) for v in labels])
            coded = coded.withColumn("_weight", F.col("_weight") * F.get(weights, F.col("_code").cast("int")))
        return VectorModel(labels, estimator.fit(coded))


def fit_random_forest(
    train: DataFrame,
    *,
    n_estimators: int = 300,
    max_depth: int | None = None,
    min_samples_leaf: int = 1,
    seed: int = SEED,
):
    """Bagged trees.  Bags draw rows; of more than ``BAG_SLICES`` equal rows they draw parts, so that a bag stays small."""
    sizes = class_sizes(train)
    labels = list(sizes)
    if len(labels) == 1:
        return ConstantModel(labels)
    estimator = RandomForestClassifier(
        featuresCol="_vector", labelCol="_code", probabilityCol="_probability", weightCol="_weight", numTrees=n_estimators,
        maxDepth=_depth(max_depth, MAX_FOREST_DEPTH), featureSubsetStrategy="sqrt",
        minInstancesPerNode=min_samples_leaf, seed=seed,
    )
    # a leaf counts rows and not weights, so parts would make it larger
    with _coded(train, labels, _slice("row_id"), each=min_samples_leaf > 1) as (coded, rows):
        if min_samples_leaf == 1:
            depth, classes = _depth(max_depth, MAX_FOREST_DEPTH), len(labels)
            votes = np.full(n_estimators, 1.0 / n_estimators)
            grown = _grown(coded, rows, lambda x, y, w, _: [(forest(x, y, w, classes, n_estimators, depth, seed), votes)])
            if grown:
                return TreesModel(labels, grown, False)
        return VectorModel(labels, estimator.fit(coded))


def fit_boosted_trees(
    train: DataFrame,
    *,
    learning_rate: float = 0.06,
    max_iter: int = 400,
    max_depth: int | None = None,
    max_bins: int = 255,
    early_stopping: bool = True,
    seed: int = SEED,
):
    """Gradient-boosted trees, one binary model per class from three classes on."""
    sizes = class_sizes(train)
    labels = list(sizes)
    if len(labels) == 1:
        return ConstantModel(labels)
    held_out = []
    settings = {}
    if early_stopping:
        key = F.conv(F.substring(shuffle_key("row_id", seed), 1, 6), 16, 10).cast("int")
        held_out.append((key % VALIDATION_SHARE == 0).alias("_held_out"))
        settings["validationIndicatorCol"] = "_held_out"
    models = []
    codes = [1] if len(labels) == 2 else list(range(len(labels)))
    depth = _depth(max_depth, DEFAULT_BOOST_DEPTH)

    def grow(features, code, weights, held):
        if held is not None and not (held.any() and (~held).any()):
            raise TooMuch
        if features.size * max_iter * len(codes) > MOST_WORK:
            raise TooMuch
        settings = {"rounds": max_iter, "rate": learning_rate, "depth": depth, "bins": max_bins}
        return [boosted(features, np.where(code == c, 1.0, -1.0), weights, held, **settings) for c in codes]

    with _coded(train, labels, *held_out) as (coded, rows):
        grown = _grown(coded, rows, grow)
        if grown:
            return TreesModel(labels, grown, True)
        for code in codes:
            estimator = GBTClassifier(
                featuresCol="_vector", labelCol="_target", weightCol="_weight", stepSize=learning_rate, maxIter=max_iter,
                maxDepth=depth, maxBins=max_bins,
                seed=seed, **settings,
            )
            target = (F.col("_code") == code).cast("double")
            models.append(estimator.fit(coded.withColumn("_target", target)))
    return OneVsRestModel(labels, models)


def fit_xgb_style(train: DataFrame, *, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 6):
    """Settings of the first boosted baseline, on pyspark.ml trees."""
    return fit_boosted_trees(
        train, learning_rate=learning_rate, max_iter=n_estimators, max_depth=max_depth, early_stopping=False
    )


def fit_cat_style(train: DataFrame, *, iterations: int = 600, learning_rate: float = 0.05, depth: int = 6):
    """Settings of the second boosted baseline; ordered boosting is not reproduced."""
    return fit_boosted_trees(
        train, learning_rate=learning_rate, max_iter=iterations, max_depth=depth, early_stopping=False
    )


def fit_neighbors(train: DataFrame, *, n_neighbors: int = 31, weights: str = "distance"):
    return NeighborModel(list(class_sizes(train)), train.select("row_id", "label", "features"), n_neighbors, weights)


def _values(hp: str) -> dict:
    # Spark writes a NaN as text, which no estimator takes
    return json.loads(re.sub(r'"NaN"', "NaN", hp or "{}"))


def used_settings(model: str, hp: str) -> str:
    """The settings that ``fit_candidate`` looks at, as JSON, with the depth that trees really get."""
    values = _values(hp)
    if model == "lr":
        used = {"C": values.get("C", 1.0), "class_weight": values.get("class_weight")}
    elif model == "rf":
        used = {
            "n_estimators": values.get("n_estimators", 600),
            "max_depth": _depth(values.get("max_depth"), MAX_FOREST_DEPTH),
            "min_samples_leaf": values.get("min_samples_leaf", 1),
        }
    elif model == "hgb":
        used = {
            "learning_rate": values.get("learning_rate", 0.06),
            "max_iter": values.get("max_iter", 400),
            "max_depth": _depth(values.get("max_depth"), DEFAULT_BOOST_DEPTH),
        }
    elif model == "knn":
        used = {"n_neighbors": values.get("n_neighbors", 31), "weights": values.get("weights", "distance")}
    else:
        raise ValueError(f"unknown model {model!r}")
    return json.dumps(used, sort_keys=True)


def _depth(asked: int | None, default: int) -> int:
    return min(asked or default, MAX_FOREST_DEPTH)


def fit_candidate(train: DataFrame, model: str, hp: str):
    """Fit by model name and sanitized hyperparameter JSON."""
    values = _values(hp)
    if model == "lr":
        return fit_logistic(train, C=values.get("C", 1.0), class_weight=values.get("class_weight"))
    if model == "rf":
        return fit_random_forest(
            train,
            n_estimators=values.get("n_estimators", 600),
            max_depth=values.get("max_depth"),
            min_samples_leaf=values.get("min_samples_leaf", 1),
        )
    if model == "hgb":
        return fit_boosted_trees(
            train,
            learning_rate=values.get("learning_rate", 0.06),
            max_iter=values.get("max_iter", 400),
            max_depth=values.get("max_depth"),
            early_stopping=sum(class_sizes(train).values()) > 10_000,
        )
    if model == "knn":
        return fit_neighbors(
            train, n_neighbors=values.get("n_neighbors", 31), weights=values.get("weights", "distance")
        )
    raise ValueError(f"unknown model {model!r}")
