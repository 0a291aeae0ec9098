"""Joins and retrieval."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabfold.operators import evaluation as E
from tabfold.operators import neighbors as N
from tabfold.operators.cleaning import standardize
from tabfold.operators.vectors import (
    list_pairs,
    measured,
    vector_topk as topk,
    vector_topk_lsh as topk_lsh,
)
from tabfold.plans.benchmark import benchmark_grid as grid, knn_fold_accuracy
from tabfold.registry.base import (
    STATUS_CODE_SQL,
    VECTORS_SQL,
    folded,
    folded_sql,
    neighbors_sql,
    orders_data,
    r6,
    table,
    vectors,
)
from tabfold.workspace import stage


def align_predictions(spark, folder):
    labels = orders_data(spark, folder).select("row_id", "label")
    predictions = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % 3).alias("pred")
    )
    aligned = E.align_predictions(predictions, labels, "row_id")
    return aligned.select("row_id", "pred", F.col("label").cast("bigint").alias("label"))


def _near(spark, folder, k, **sizes):
    data = folded(vectors(spark, folder))
    return data, N.k_nearest(data, data, k, test_id="row_id", train_id="row_id", payload="label", group="fold", **sizes)


def knn_topk(spark, folder):
    """In chunks so small that the table takes several: the form that large tables take."""
    _, near = _near(spark, folder, 3, chunk_rows=128, block_rows=256)
    return near.select(
        "test_id", "train_id", F.col("rank").cast("bigint").alias("rank"), r6("dist").alias("dist")
    )


def knn_vote_uniform(spark, folder):
    _, near = _near(spark, folder, 3)
    return N.vote_uniform(near).select("test_id", F.col("pred").cast("bigint").alias("pred"))


def knn_vote_distance(spark, folder):
    data = vectors(spark, folder)
    scaled = folded(standardize(data, data))
    near = N.k_nearest(scaled, scaled, 31, test_id="row_id", train_id="row_id", payload="label", group="fold")
    return N.vote_distance(near).select("test_id", F.col("pred").cast("bigint").alias("pred"))


def vector_topk(spark, folder):
    stored = table(spark, folder, "embeddings")
    found = topk(stored, stored, 5, query_id="vec_id", stored_id="vec_id", embedding="embedding")
    return found.select(
        "test_id", "train_id", F.col("rank").cast("bigint").alias("rank"), r6("sq_dist").alias("sq_dist")
    )


#: A search asks for every row whose id this divides, against all rows.
ASKED = 50


def vector_topk_ivf(spark, folder):
    """Recall and cost of the inverted file over vectors without clusters, the worst case: three quarters of the lists are probed.

    All vectors are indexed; queries are the rows whose id is divisible by ``ASKED``.
    """
    stored = table(spark, folder, "embeddings")
    queries = stored.where(F.col("vec_id") % ASKED == 0)
    count, asked = stored.count(), queries.count()
    lists = math.isqrt(count)
    names = dict(query_id="vec_id", stored_id="vec_id", embedding="embedding")
    pairs = stage(list_pairs(queries, stored, 5, **names, lists=lists, nprobe=(3 * lists) // 4), "pairs")
    found = stage(measured(pairs, queries, stored, 5, **names), "found")
    exact = topk(queries, stored, 5, **names).select("test_id", "train_id")
    hits = exact.join(found, ["test_id", "train_id"], "left_semi").count()
    row = (hits >= 0.9 * 5 * asked, pairs.count() <= 0.1 * asked * count, found.count() == 5 * asked)
    return spark.createDataFrame([row], "recall_reached boolean, few_measured boolean, all_answered boolean")


def vector_topk_lsh(spark, folder):
    stored = table(spark, folder, "embeddings")
    return topk_lsh(
        stored, stored, 5, query_id="vec_id", stored_id="vec_id", embedding="embedding", bucket_length=0.25, width=4
    )


def neighbor_examples(spark, folder):
    data, near = _near(spark, folder, 3)
    rows = N.neighbor_rows(near, data, "row_id", ["features", "label"])
    lists = N.neighbor_lists(rows, ["features", "label"])
    flat = lists.select("test_id", F.posexplode("neighbors").alias("place", "n"))
    return flat.select(
        "test_id",
        F.col("place").cast("bigint").alias("place"),
        F.col("n.train_id").alias("train_id"),
        r6(F.col("n.features")[0]).alias("f0"),
        F.col("n.label").cast("bigint").alias("label"),
    )


def benchmark_grid(spark, folder):
    datasets = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("dataset")).distinct()
    cells = grid(datasets, 5, ["KNN", "LR", "HGB"])
    return cells.select("dataset", F.col("fold").cast("bigint").alias("fold"), "method")


def fold_accuracy(spark, folder):
    scored = knn_fold_accuracy(folded(vectors(spark, folder)))
    return scored.select(F.col("fold").cast("bigint").alias("fold"), r6("accuracy").alias("accuracy"), "n_rows")


def mean_accuracy(spark, folder):
    scored = knn_fold_accuracy(folded(vectors(spark, folder))).withColumn("method", F.lit("KNN"))
    return E.mean_accuracy(scored, ["method"]).select("method", r6("mean_accuracy").alias("mean_accuracy"), "n_folds")


QUERIES = {
    "align_predictions": align_predictions,
    "knn_topk": knn_topk,
    "knn_vote_uniform": knn_vote_uniform,
    "knn_vote_distance": knn_vote_distance,
    "vector_topk": vector_topk,
    "vector_topk_ivf": vector_topk_ivf,
    "vector_topk_lsh": vector_topk_lsh,
    "neighbor_examples": neighbor_examples,
    "benchmark_grid": benchmark_grid,
    "fold_accuracy": fold_accuracy,
    "mean_accuracy": mean_accuracy,
}

_NEAR = f"WITH {VECTORS_SQL}, {folded_sql()}, {neighbors_sql(3)}"
VOTE_SQL = """votes AS (
  SELECT test_id, payload AS pred, row_number() OVER (PARTITION BY test_id ORDER BY count(*) DESC, payload) AS n
  FROM near GROUP BY test_id, payload)"""
ACCURACY_SQL = """fold_scores AS (
  SELECT fold, avg((pred = label)::INTEGER) AS accuracy, count(*) AS n_rows
  FROM votes JOIN folded ON test_id = row_id WHERE n = 1 GROUP BY fold)"""

ORACLES = {
    "align_predictions": f"""SELECT o_orderkey AS row_id, o_custkey % 3 AS pred, {STATUS_CODE_SQL}::BIGINT AS label
        FROM orders""",
    "knn_topk": f"{_NEAR} SELECT test_id, train_id, rank, round(dist, 6) AS dist FROM near",
    "knn_vote_uniform": f"{_NEAR}, {VOTE_SQL} SELECT test_id, pred::BIGINT AS pred FROM votes WHERE n = 1",
    "knn_vote_distance": f"""WITH raw AS (
          SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
        moments AS (SELECT p, avg(x) AS m, stddev_pop(x) AS s FROM raw GROUP BY p),
        data AS (SELECT vec_id AS row_id, label, list((x - m) / s ORDER BY p) AS features
                 FROM raw JOIN moments USING (p) GROUP BY vec_id, label),
        {folded_sql()}, {neighbors_sql(31)},
        weights AS (SELECT test_id, payload, CASE WHEN min(dist) OVER (PARTITION BY test_id) = 0
                    THEN (dist = 0)::INTEGER::DOUBLE ELSE 1 / dist END AS w FROM near),
        votes AS (SELECT test_id, payload AS pred,
                  row_number() OVER (PARTITION BY test_id ORDER BY sum(w) DESC, payload) AS n
                  FROM weights GROUP BY test_id, payload)
        SELECT test_id, pred::BIGINT AS pred FROM votes WHERE n = 1""",
    "vector_topk": """WITH pairs AS (
          SELECT a.vec_id AS test_id, b.vec_id AS train_id,
                 list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
          FROM embeddings a CROSS JOIN embeddings b),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY d, train_id) AS rank FROM pairs)
        SELECT test_id, train_id, rank, round(d * d, 6) AS sq_dist FROM ranked WHERE rank <= 5""",
    "vector_topk_ivf": "SELECT true AS recall_reached, true AS few_measured, true AS all_answered",
    "neighbor_examples": f"""{_NEAR} SELECT test_id, rank - 1 AS place, train_id, round(f.features[1], 6) AS f0,
        f.label::BIGINT AS label FROM near JOIN folded f ON train_id = f.row_id""",
    "benchmark_grid": """SELECT dataset, fold, method FROM (SELECT DISTINCT c_mktsegment AS dataset FROM customer)
        CROSS JOIN (SELECT range AS fold FROM range(5)) CROSS JOIN (VALUES ('KNN'), ('LR'), ('HGB')) m(method)""",
    "fold_accuracy": f"""{_NEAR}, {VOTE_SQL}, {ACCURACY_SQL}
        SELECT fold::BIGINT AS fold, round(accuracy, 6) AS accuracy, n_rows FROM fold_scores""",
    "mean_accuracy": f"""{_NEAR}, {VOTE_SQL}, {ACCURACY_SQL}
        SELECT 'KNN' AS method, round(avg(accuracy), 6) AS mean_accuracy, count(*) AS n_folds FROM fold_scores""",
}
