"""Datasets x folds x methods -> accuracy rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabfold.functions.text import summary_hp, summary_model
from tabfold.models import estimators as M
from tabfold.models.overlap import overlapped
from tabfold.operators.cleaning import head_fraction, split_target
from tabfold.operators.neighbors import k_nearest, vote_uniform
from tabfold.operators.sampling import stratified_kfold, test_rows, train_rows
from tabfold.plans import prompting
from tabfold.plans.selection import meta_select_predict
from tabfold.sources.delimited import scan_csv_positional
from tabfold.sources.results import scan_results, sink_results
from tabfold.sources.sidecar import dataset_catalog, ready_datasets, scan_metadata
from tabfold.workspace import exists, stage

Method = Callable[[DataFrame, DataFrame], DataFrame]
N_SPLITS = 5
K_NEIGHBORS = 3

# Method names of a benchmark configuration.
_FITTED: dict[str, Callable] = {
    "LR": M.fit_logistic,
    "HGB": M.fit_boosted_trees,
    "RandomForest": M.fit_random_forest,
    "XGB": M.fit_xgb_style,
    "CatBoost": M.fit_cat_style,
}
_PROMPTED: dict[str, Callable] = {
    "NSP": prompting.classify_zero_shot,
    "FSP": prompting.classify_few_shot,
    "Hybrid_model": prompting.classify_hybrid,
    "RAG": prompting.classify_rag,
}


def benchmark_grid(datasets: DataFrame, folds: int, methods: list[str]) -> DataFrame:
    """One row per dataset, fold and method."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")
    method = F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")
    return datasets.select("dataset", fold).select("dataset", "fold", method)


def knn_fold_accuracy(folded: DataFrame, k: int = K_NEIGHBORS, **sizes) -> DataFrame:
    """``fold, accuracy, n_rows`` of the k-neighbour vote, all folds in one search.

    Equal rows of one fold have equal neighbours: one of them is searched for all, and their labels are counted.
    """
    asked = folded.groupBy("features", "fold", "label").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
    asked = asked.groupBy("features", "fold").agg(
        F.min("row_id").alias("row_id"), F.collect_list(F.struct("label", "n")).alias("counts")
    )
    asked = stage(asked, "asked")
    found = k_nearest(
        asked, folded, k, test_id="row_id", train_id="row_id", payload="label", group="fold", **sizes
    )
    scored = vote_uniform(found).withColumnRenamed("test_id", "row_id").join(asked.select("row_id", "fold", "counts"), "row_id")
    total = lambda counts: F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    hits, rows = total(F.filter("counts", lambda c: c["label"].eqNullSafe(F.col("pred")))), total(F.col("counts"))
    sums = scored.groupBy("fold").agg(F.sum(hits).alias("hits"), F.sum(rows).alias("n_rows"))
    return sums.select("fold", (F.col("hits") / F.col("n_rows")).alias("accuracy"), "n_rows")


def _predict(method: str, train: DataFrame, test: DataFrame, settings: dict) -> DataFrame:
    if method in _FITTED:
        return _FITTED[method](train, **settings).score(test).select("row_id", "label", "pred")
    if method in _PROMPTED:
        return _PROMPTED[method](train, test, **settings).join(test.select("row_id", "label"), "row_id")
    if method == "MetaSelectorLLM":
        return meta_select_predict(train, test, **settings)
    raise ValueError(f"unknown method {method!r}")


def _cell(method: str, folded: DataFrame, fold: int, settings: dict) -> DataFrame:
    """One row ``fold, accuracy, model, hyperparameters``."""
    train, test = train_rows(folded, fold).drop("fold"), test_rows(folded, fold).drop("fold")
    scored = _predict(method, train, test, settings)
    text = F.first("summary") if "summary" in scored.columns else F.lit("")
    hit = F.avg(F.col("pred").eqNullSafe(F.col("label")).cast("double"))
    row = scored.agg(hit.alias("accuracy"), text.alias("s"))
    return row.select(
        F.lit(fold).alias("fold"),
        "accuracy",
        F.when(F.col("s") != "", summary_model(F.col("s"))).otherwise("").alias("model"),
        F.when(F.col("s") != "", summary_hp(F.col("s"))).otherwise("").alias("hyperparameters"),
    )


def benchmark_jobs(
    folded: DataFrame, dataset: str, wanted: dict[str, list[int]], settings: dict | None = None
) -> list[tuple[str, Callable[[], DataFrame]]]:
    """Named jobs that give the result rows of the ``wanted`` folds by method over a folded table.

    Neighbour votes of all folds come from one search; every other job is one cell, fitted when it is called.
    """
    settings = settings or {}
    unknown = set(wanted) - set(_FITTED) - set(_PROMPTED) - {"KNN", "MetaSelectorLLM"}
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")

    def rows(method: str, folds: list[int]) -> DataFrame:
        chosen = settings.get(method, {})
        if method == "KNN":
            part = knn_fold_accuracy(folded, **chosen).where(F.col("fold").isin(folds))
            part = part.select("fold", "accuracy", F.lit("").alias("model"), F.lit("").alias("hyperparameters"))
        else:
            part = _cell(method, folded, folds[0], chosen)
        return part.select(F.lit(dataset).alias("dataset"), "fold", F.lit(method).alias("method"), "accuracy", "model", "hyperparameters")

    jobs = []
    for method, folds in wanted.items():
        for some in ([folds] if method == "KNN" and folds else [[f] for f in folds]):
            jobs.append((f"{dataset} {method} {some}", partial(rows, method, some)))
    return jobs


def benchmark_cells(
    folded: DataFrame, dataset: str, wanted: dict[str, list[int]], settings: dict | None = None
) -> Iterator[DataFrame]:
    """The frames of ``benchmark_jobs``, one after the other."""
    for _, job in benchmark_jobs(folded, dataset, wanted, settings):
        yield job()


def benchmark_table(
    data: DataFrame, dataset: str, methods: list[str], *, folds: int = N_SPLITS, settings: dict | None = None
) -> DataFrame:
    """Results of all methods on one ``row_id, label, features`` table.

    ``settings`` gives keyword arguments by method name.  Every method of every fold is scored.
    """
    folded = stage(stratified_kfold(data, "label", "row_id", folds), "benchmark-folds")
    parts = benchmark_cells(folded, dataset, {m: list(range(folds)) for m in methods}, settings)
    return reduce(DataFrame.unionByName, parts)


def remaining_cells(done: DataFrame, datasets: DataFrame, folds: int, methods: list[str]) -> DataFrame:
    """The cells ``dataset, fold, method`` of the grid that have no result yet."""
    return benchmark_grid(datasets, folds, methods).join(done, ["dataset", "fold", "method"], "left_anti")


def resume_benchmark(
    data: DataFrame, dataset: str, methods: list[str], out: str, *, folds: int = N_SPLITS, settings: dict | None = None,
    open_fits: int = 1,
) -> DataFrame:
    """Appends the cells of one table that ``out`` lacks, each as it is done; returns all results in ``out``.

    With ``open_fits`` cells are open side by side, and one that fails raises when the others are done.  A run that breaks off keeps the cells it has finished, and the next goes on from there: folds follow from the rows and are
    the same again.
    """
    spark = data.sparkSession
    if not exists(spark, out):
        sink_results(spark.createDataFrame([], "dataset string"), out, fresh=True)
    named = spark.createDataFrame([(dataset,)], "dataset string")
    todo = remaining_cells(scan_results(spark, out), named, folds, methods).orderBy("fold").collect()  # folds x methods
    if todo:
        folded = stage(stratified_kfold(data, "label", "row_id", folds), "benchmark-folds")
        wanted = {m: [c["fold"] for c in todo if c["method"] == m] for m in methods}
        one_at_a_time = Lock()  # two jobs must not append to one folder at once

        def append(job: Callable[[], DataFrame]) -> None:
            done = stage(job().coalesce(1), "cells")
            with one_at_a_time:
                sink_results(done, out)

        jobs = [(name, partial(append, job)) for name, job in benchmark_jobs(folded, dataset, wanted, settings)]
        if open_fits == 1:
            for _, job in jobs:
                job()
        else:
            errors = [error for _, error in overlapped(spark, jobs, open_fits) if error is not None]
            if errors:
                raise RuntimeError("; ".join(errors))
    return scan_results(spark, out)


def run_benchmark(
    spark: SparkSession,
    folder: str,
    datasets: list[str],
    methods: list[str],
    out: str,
    *,
    folds: int = N_SPLITS,
    sample: float = 1.0,
    settings: dict | None = None,
    resume: bool = False,
) -> DataFrame:
    """Benchmark the dataset folders that are complete; results go to ``out``, afresh unless ``resume`` is set.

    Each cell is written as it is done; ``resume`` does only those that ``out`` lacks.
    """
    wanted = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    ready = {r["dataset"] for r in ready_datasets(dataset_catalog(spark, folder), wanted).collect()}
    if not resume or not exists(spark, out):
        sink_results(spark.createDataFrame([], "dataset string"), out, fresh=True)
    for name in [d for d in datasets if d in ready]:
        base = f"{folder.rstrip('/')}/{name}/{name}"
        target = scan_metadata(spark, f"{base}_metadata.json").first()["target_column_index"]
        table = scan_csv_positional(spark, f"{base}.csv", row_id="row_id")
        table = head_fraction(table, sample, "row_id")
        data = stage(split_target(table, target, carry=["row_id"]), "dataset")
        resume_benchmark(data, name, methods, out, folds=folds, settings=settings)
    return scan_results(spark, out)
