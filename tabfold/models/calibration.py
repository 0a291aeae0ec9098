"""Probability calibration by held-out folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from tabfold.functions.numbers import argmax_label
from tabfold.models.estimators import _labels, equal_rows
from tabfold.operators.sampling import stratified_kfold, test_rows, train_rows
from tabfold.workspace import stage

BINS = 10_000
ISOTONIC_FROM = 2000
FEW_FOLDS_FROM = 1000


def _histogram(scored: DataFrame, at: int, label) -> DataFrame:
    """Scores of one class on a grid: at most ``BINS`` + 1 rows go into a calibrator."""
    share, weight = F.col("probabilities")[at], F.col("_weight")
    return (
        scored.groupBy(F.round(share * BINS).alias("bin"))
        .agg(
            F.sum(share * weight).alias("x"),
            F.sum((F.col("label") == label).cast("double") * weight).alias("y"),
            F.sum(weight).alias("w"),
        )
        .select(F.col("x") / F.col("w"), F.col("y") / F.col("w"), "w")
        .toDF("x", "y", "w")
    )


def _logit(x):
    clipped = F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(clipped / (1 - clipped))


def _fit_isotonic(histogram: DataFrame):
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(histogram)


def _fit_sigmoid(histogram: DataFrame):
    """One-feature logistic fit on targets pulled away from 0 and 1 by the class counts."""
    counts = histogram.agg(F.sum(F.col("y") * F.col("w")).alias("p"), F.sum("w").alias("n")).first()
    positive, negative = counts["p"], counts["n"] - counts["p"]
    high, low = (positive + 1) / (positive + 2), 1 / (negative + 2)
    ones = F.col("w") * (F.col("y") * high + (1 - F.col("y")) * low)
    sides = F.explode(
        F.array(F.struct(F.lit(1.0).alias("t"), ones.alias("v")), F.struct(F.lit(0.0).alias("t"), (F.col("w") - ones).alias("v")))
    ).alias("side")
    rows = histogram.select("x", sides).select(
        array_to_vector(F.array(_logit(F.col("x")))).alias("f"), "side.t", "side.v"
    )
    return LogisticRegression(
        featuresCol="f", labelCol="t", weightCol="v", regParam=0.0, maxIter=200, standardization=False
    ).fit(rows)


@dataclass
class CalibratedModel:
    """Mean of the calibrated fold models."""

    labels: list
    method: str
    parts: list[tuple[Any, list]]  # a fold's model and its calibrators, one per class

    def _calibrated(self, scored: DataFrame, calibrators: list, name: str) -> DataFrame:
        keep = [c for c in scored.columns if c not in ("probabilities", "pred")]
        two = len(self.labels) == 2
        shares = []
        for i, calibrator in enumerate(calibrators):
            at = 1 if two else i
            if self.method == "isotonic":
                scored = scored.withColumn("x", F.col("probabilities")[at])
                calibrator = calibrator.copy({calibrator.predictionCol: f"_q{i}"})
                scored = calibrator.transform(scored).drop("x")
            else:
                slope, offset = float(calibrator.coefficients[0]), float(calibrator.intercept)
                value = 1 / (1 + F.exp(-(F.lit(slope) * _logit(F.col("probabilities")[at]) + F.lit(offset))))
                scored = scored.withColumn(f"_q{i}", value)
            shares.append(F.col(f"_q{i}"))
        if two:
            shares = [1 - shares[0], shares[0]]
        total = sum(shares[1:], shares[0])
        even = F.lit(1.0 / len(self.labels))
        fixed = F.array(*[F.when(total > 0, s / total).otherwise(even) for s in shares])
        return scored.select(*keep, fixed.alias(name))

    def score(self, df: DataFrame) -> DataFrame:
        scored = df
        names = []
        for i, (model, calibrators) in enumerate(self.parts):
            names.append(f"_fold{i}")
            scored = self._calibrated(model.score(scored), calibrators, names[-1])
        mean = F.array(
            *[sum((F.col(n)[c] for n in names[1:]), F.col(names[0])[c]) / len(names) for c in range(len(self.labels))]
        )
        scored = scored.withColumn("probabilities", mean)
        return scored.withColumn("pred", argmax_label(mean, _labels(self.labels))).select(
            *df.columns, "probabilities", "pred"
        )


def calibrate(
    train: DataFrame,
    labels: list,
    fit: Callable[[DataFrame], Any],
    n_rows: int,
    *,
    method: str | None = None,
    folds: int | None = None,
) -> CalibratedModel:
    """Fit on each fold's training part and learn from its test part how to correct the scores.

    Isotonic from 2000 rows on, else sigmoid; three folds from 1000 rows on, else five.
    """
    method = method or ("isotonic" if n_rows >= ISOTONIC_FROM else "sigmoid")
    folds = folds or (3 if n_rows >= FEW_FOLDS_FROM else 5)
    folded = stage(stratified_kfold(train, "label", "row_id", folds), "calibration-folds")
    parts = []
    for fold in range(folds):
        model = fit(train_rows(folded, fold).drop("fold"))
        if model.labels != labels:
            raise ValueError("a class is missing from a training part")
        # equal rows have equal scores
        rows = equal_rows(test_rows(folded, fold)).withColumn("row_id", F.monotonically_increasing_id())
        scored = stage(model.score(stage(rows, "held-out")).select("label", "probabilities", "_weight"), "scores")
        calibrators = []
        for at in [1] if len(labels) == 2 else range(len(labels)):
            # BINS rows at most: one partition is enough for the passes of a fit
            histogram = _histogram(scored, at, labels[at]).coalesce(1).persist()
            try:
                learn = _fit_isotonic if method == "isotonic" else _fit_sigmoid
                calibrators.append(learn(histogram))
            finally:
                histogram.unpersist()
        parts.append((model, calibrators))
    return CalibratedModel(labels, method, parts)
