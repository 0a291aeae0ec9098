"""Predictions against labels, accuracies, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def align_predictions(predictions: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Put predictions beside labels, row by row."""
    return predictions.join(labels, row_id)


def hit() -> Column:
    return F.col("pred").eqNullSafe(F.col("label")).cast("double")


def fold_accuracy(scored: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows with ``pred`` equal to ``label`` per group."""
    return scored.groupBy(*by).agg(F.avg(hit()).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def mean_accuracy(accuracies: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the fold accuracies per group."""
    return accuracies.groupBy(*by).agg(
        F.avg("accuracy").alias("mean_accuracy"), F.count(F.lit(1)).alias("n_folds")
    )


def leaderboard(scores: DataFrame, *, size: int = 6) -> DataFrame:
    """Best ``size`` rows of a ``ord, score`` table; equal scores keep their order, failures drop out."""
    usable = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    top = usable.orderBy(F.desc("score"), "ord").limit(size)
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "ord")
    return top.withColumn("place", F.row_number().over(place))


def best_candidate(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """First candidate with the highest score; a missing or NaN score never wins.

    Aggregates on the map side, so one row per group leaves each task.
    """
    # scores start from -1, so anything not above it loses to the default
    usable = F.when(F.col("score") > -1.0, F.when(~F.isnan("score"), F.col("score")))
    rank = F.when(usable.isNotNull(), F.struct(usable.alias("s"), (-F.col("ord")).alias("o")))
    return scores.groupBy(*(by or [])).agg(
        F.max_by(F.struct("ord", "model", "hp", "score"), rank).alias("best")
    )
