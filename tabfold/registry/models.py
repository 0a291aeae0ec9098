"""Fitted models with their default settings, over all rows of all five folds.

The labels follow a rule over two columns, so SQL can tell what a sound fit predicts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.models import estimators as M
from tabfold.models.calibration import calibrate
from tabfold.plans.benchmark import resume_benchmark
from tabfold.plans.candidates import sanitize_candidates
from tabfold.plans.selection import evaluate_candidates as evaluate, meta_select_predict as select_and_predict
from tabfold.registry.base import RULED_SQL, over_folds, ruled_data
from tabfold.registry.prompted import stub_proposal
from tabfold.workspace import new_folder, stage

FOLDS_AT_ONCE = 5


def _pred(scored):
    return scored.select("row_id", "label", F.col("pred").cast("bigint").alias("pred"))


def _crossed(spark, folder, fit):
    return over_folds(ruled_data(spark, folder), lambda train, test: _pred(fit(train).score(test)), open_fits=FOLDS_AT_ONCE)


def fit_logistic(spark, folder):
    return _crossed(spark, folder, M.fit_logistic)


def fit_random_forest(spark, folder):
    return _crossed(spark, folder, M.fit_random_forest)


def fit_boosted_trees(spark, folder):
    return _crossed(spark, folder, M.fit_boosted_trees)


def fit_xgb_style(spark, folder):
    return _crossed(spark, folder, M.fit_xgb_style)


def fit_cat_style(spark, folder):
    return _crossed(spark, folder, M.fit_cat_style)


def _calibrated(method):
    def fit(train):
        sizes = M.class_sizes(train)
        return calibrate(train, list(sizes), M.fit_logistic, sum(sizes.values()), method=method)

    return fit


def calibrate_isotonic(spark, folder):
    return _crossed(spark, folder, _calibrated("isotonic"))


def calibrate_sigmoid(spark, folder):
    return _crossed(spark, folder, _calibrated("sigmoid"))


def evaluate_candidates(spark, folder):
    """Every kind of candidate with its default settings."""
    data = ruled_data(spark, folder)
    proposed = spark.createDataFrame([(i, m, "{}", "") for i, m in enumerate(["lr", "knn", "rf"])], "ord int, model string, hp string, why string")
    facts = proposed.withColumn("n_rows", data.agg(F.count(F.lit(1)).alias("n")).scalar())
    scores = evaluate(data, sanitize_candidates(facts, "n_rows").drop("n_rows"))
    return scores.select("ord", "model", F.round("score", 6).alias("score"), F.col("error").isNotNull().alias("failed"))


def run_benchmark(spark, folder):
    """Three methods in five folds, begun with one of them and resumed with all: each cell comes once."""
    data = stage(ruled_data(spark, folder), "ruled")
    out = new_folder(spark, "results")
    resume_benchmark(data, "orders", ["KNN"], out)
    rows = resume_benchmark(data, "orders", ["KNN", "LR", "RandomForest"], out, open_fits=FOLDS_AT_ONCE)
    return rows.select("dataset", F.col("fold").cast("bigint").alias("fold"), "method", F.round("accuracy", 6).alias("accuracy"))


def meta_select_predict(spark, folder):
    """The proposal of a reply and the baselines, cross-validated, the best calibrated and applied; the folds run side by side."""
    predict = lambda train, test: _pred(select_and_predict(train, test, stub_proposal, open_fits=1))
    return over_folds(ruled_data(spark, folder), predict, open_fits=FOLDS_AT_ONCE)


QUERIES = {
    "fit_logistic": fit_logistic,
    "fit_random_forest": fit_random_forest,
    "fit_boosted_trees": fit_boosted_trees,
    "fit_xgb_style": fit_xgb_style,
    "fit_cat_style": fit_cat_style,
    "calibrate_isotonic": calibrate_isotonic,
    "calibrate_sigmoid": calibrate_sigmoid,
    "evaluate_candidates": evaluate_candidates,
    "run_benchmark": run_benchmark,
    "meta_select_predict": meta_select_predict,
}

ORACLES = {
    **{name: RULED_SQL for name in QUERIES if name.startswith(("fit_", "calibrate_"))},
    "meta_select_predict": RULED_SQL,
    "run_benchmark": """SELECT 'orders' AS dataset, fold, method, 1.0::DOUBLE AS accuracy
        FROM (SELECT range AS fold FROM range(5)) CROSS JOIN (VALUES ('KNN'), ('LR'), ('RandomForest')) m(method)""",
    "evaluate_candidates": """SELECT ord::BIGINT AS ord, model, 1.0::DOUBLE AS score, false AS failed
        FROM (VALUES (0, 'lr'), (1, 'knn'), (2, 'rf')) t(ord, model)""",
}
