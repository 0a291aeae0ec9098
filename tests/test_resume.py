"""A benchmark that goes on where it broke off."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfold.plans import benchmark as B
from tabfold.sources.results import scan_results
from tabfold.sources.sidecar import prepare_dataset

SCHEMA = "row_id bigint, label int, features array<double>"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=2) + 4 * (i % 2)]) for i in range(90)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def _cells(frame):
    return Counter((r["dataset"], r["fold"], r["method"]) for r in frame.collect())


def test_a_broken_run_goes_on(spark, blobs, tmp_path, monkeypatch):
    out, fitted = f"{tmp_path}/out", []
    plain = B._FITTED["LR"]

    def failing(train, **settings):
        if len(fitted) == 2:
            raise RuntimeError("lost")
        fitted.append(1)
        return plain(train, **settings)

    monkeypatch.setitem(B._FITTED, "LR", failing)
    with pytest.raises(RuntimeError, match="lost"):
        B.resume_benchmark(blobs, "d", ["LR", "KNN"], out, folds=3)
    assert _cells(scan_results(spark, out)) == {("d", 0, "LR"): 1, ("d", 1, "LR"): 1}
    monkeypatch.setitem(B._FITTED, "LR", lambda train, **settings: (fitted.append(1), plain(train, **settings))[1])
    done = B.resume_benchmark(blobs, "d", ["LR", "KNN"], out, folds=3)
    assert _cells(done) == {("d", f, m): 1 for f in range(3) for m in ("LR", "KNN")}
    assert len(fitted) == 3
    # nothing is left to do, and one method more does only its own cells
    assert _cells(B.resume_benchmark(blobs, "d", ["LR", "KNN"], out, folds=3)) == _cells(done)
    whole = B.benchmark_table(blobs, "d", ["LR", "KNN"], folds=3)
    keys = ["dataset", "fold", "method", "accuracy"]
    assert sorted(map(tuple, done.select(keys).collect())) == sorted(map(tuple, whole.select(keys).collect()))


def test_folders_resume(spark, blobs, tmp_path):
    for name in ("one", "two"):
        prepare_dataset(blobs.selectExpr("row_id", "label", "features[0] a", "features[1] b"), str(tmp_path), name, target=0, order="row_id")
    out = f"{tmp_path}/out"
    first = B.run_benchmark(spark, str(tmp_path), ["one"], ["KNN"], out, folds=2)
    assert len(_cells(first)) == 2
    both = B.run_benchmark(spark, str(tmp_path), ["one", "two"], ["KNN"], out, folds=2, resume=True)
    assert _cells(both) == {(d, f, "KNN"): 1 for d in ("one", "two") for f in (0, 1)}
    afresh = B.run_benchmark(spark, str(tmp_path), ["two"], ["KNN"], out, folds=2)
    assert _cells(afresh) == {("two", f, "KNN"): 1 for f in (0, 1)}
    left = B.remaining_cells(afresh, spark.createDataFrame([("two",)], "dataset string"), 3, ["KNN", "LR"])
    assert _cells(left) == {("two", 2, "KNN"): 1, **{("two", f, "LR"): 1 for f in range(3)}}
    assert afresh.where(F.col("accuracy") < 0.9).count() == 0


def test_cells_side_by_side(spark, blobs, tmp_path):
    done = B.resume_benchmark(blobs, "d", ["LR", "KNN"], f"{tmp_path}/out", folds=3, open_fits=4)
    assert _cells(done) == {("d", f, m): 1 for f in range(3) for m in ("LR", "KNN")}


def test_equal_rows_are_searched_once(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id AS row_id", "cast(id % 3 = 0 AS int) AS label", "array(cast(id % 5 AS double)) AS features", "cast(id % 2 AS int) AS fold")
    rows = rows.cache()
    near = B.k_nearest(rows, rows, 3, test_id="row_id", train_id="row_id", payload="label", group="fold")
    truth = B.vote_uniform(near).withColumnRenamed("test_id", "row_id").join(rows, "row_id")
    expected = truth.groupBy("fold").agg(F.avg((F.col("pred") == F.col("label")).cast("double")), F.count(F.lit(1)))
    asked, real = [], B.k_nearest
    monkeypatch.setattr(B, "k_nearest", lambda test, *rest, **more: (asked.append(test.count()), real(test, *rest, **more))[1])
    found = B.knn_fold_accuracy(rows)
    assert asked == [10]
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in expected.collect()}
