"""Candidate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.functions.text import is_metadata_echo
from tabfold.plans import candidates as C
from tabfold.plans.selection import neighbor_cv_scores
from tabfold.registry.base import (
    VECTORS_SQL,
    customer_data,
    folded,
    folded_sql,
    neighbors_sql,
    r6,
    table,
    vectors,
)


def _replies(spark, folder):
    """Proposals of five shapes from the orders."""
    key, size = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    text = (
        F.when(
            key == 0,
            F.concat(
                F.lit('Here: {"candidates": [{"model": "rf", "hyperparameters": {"n_estimators": '), size,
                F.lit('}, "why": "w"}, {"model": "lr", "hyperparameters": {"C": "2"}}]} done'),
            ),
        )
        .when(
            key == 1,
            F.concat(
                F.lit('{"num_features": 3} and {"model": "knn", "hyperparameters": {"n_neighbors": '), size,
                F.lit('}, "reasoning": "near"}'),
            ),
        )
        .when(key == 2, '{"candidates": [{"model": "svm"}, {"model": "rf"}]}')
        .when(key == 3, F.concat(F.lit('```{"candidates": []}``` {"model": "hgb", "hyperparameters": {"max_iter": '), size, F.lit("}}")))
        .otherwise("sorry, no idea")
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("reply"))


def parse_candidates(spark, folder):
    found = C.parse_candidates(_replies(spark, folder), "reply")
    size = F.regexp_extract("hp", r"([0-9]+)", 1).cast("bigint")
    return found.select("o_orderkey", F.col("ord").cast("bigint").alias("ord"), "model", size.alias("size"), "why")


def sanitize_candidates(spark, folder):
    key = F.col("o_orderkey") % 4
    size = F.col("o_custkey").cast("string")
    model = F.when(key == 0, "rf").when(key == 1, "lr").when(key == 2, "hgb").otherwise("knn")
    hp = (
        F.when(key == 0, F.concat(F.lit('{"n_estimators": '), size, F.lit(', "max_depth": "None", "junk": 1}')))
        .when(key == 1, F.concat(F.lit('{"C": "'), size, F.lit('", "class_weight": "balanced"}')))
        .when(key == 2, F.concat(F.lit('{"max_depth": '), size, F.lit('.9, "learning_rate": 7}')))
        .otherwise(F.concat(F.lit('{"n_neighbors": '), size, F.lit(', "weights": "x"}')))
    )
    rows = table(spark, folder, "orders").select(
        "o_orderkey", model.alias("model"), hp.alias("hp"), F.col("o_custkey").alias("n_rows")
    )
    clean = C.sanitize_candidates(rows, "n_rows")
    back = F.from_json("hp", "C double, class_weight string, n_estimators bigint, max_depth bigint, learning_rate double, n_neighbors bigint, weights string")
    return clean.select("o_orderkey", "model", F.size(F.json_object_keys("hp")).cast("bigint").alias("n_keys"), back.alias("h")).select(
        "o_orderkey", "model", "n_keys", "h.*"
    )


def _groups(spark, folder):
    """Shape of each 'dataset': one per order priority, labelled by status."""
    counts = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.groupBy("dataset").agg(
        F.sum("n").alias("n_rows"), (F.max("n") / F.sum("n")).alias("max_prior")
    )


def augment_baselines(spark, folder):
    # one group has a dominant class, to get balanced weights
    groups = _groups(spark, folder).withColumn(
        "max_prior", F.when(F.col("dataset").startswith("1"), 0.9).otherwise(F.col("max_prior"))
    )
    rows = C.sanitize_candidates(C.baselines(groups, "n_rows", "max_prior"), "n_rows")
    return rows.select("dataset", F.col("ord").cast("bigint").alias("ord"), "model", "hp")


def candidate_pool(spark, folder):
    proposals = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n")
    )
    status = F.col("o_orderstatus")
    proposals = proposals.select(
        "dataset",
        F.when(status == "F", 0).when(status == "O", 1).otherwise(2).alias("ord"),
        F.when(status == "O", "knn").otherwise("rf").alias("model"),
        F.when(status == "O", '{"n_neighbors": 97}').otherwise('{"n_estimators": 10}').alias("hp"),
        F.lit("w").alias("why"),
    )
    pool = C.candidate_pool(proposals, _groups(spark, folder), ["dataset"], "n_rows", "max_prior")
    return pool.select("dataset", F.col("ord").cast("bigint").alias("ord"), "model", "hp")


def metadata_echo_filter(spark, folder):
    key = F.col("o_orderkey") % 3
    text = (
        F.when(key == 0, F.concat(F.lit('{"num_samples": '), "o_custkey", F.lit("}")))
        .when(key == 1, F.concat(F.lit('{"model": "lr", "n": '), "o_custkey", F.lit("}")))
        .otherwise("[1, 2]")
    )
    blocks = table(spark, folder, "orders").select("o_orderkey", text.alias("block"))
    return blocks.filter(~is_metadata_echo(F.col("block")))


def evaluate_knn_candidates(spark, folder):
    scores = neighbor_cv_scores(folded(vectors(spark, folder)), [(0, 3, "uniform"), (1, 15, "distance")])
    return scores.select(F.col("ord").cast("bigint").alias("ord"), r6("score").alias("score"))


QUERIES = {
    "parse_candidates": parse_candidates,
    "sanitize_candidates": sanitize_candidates,
    "augment_baselines": augment_baselines,
    "candidate_pool": candidate_pool,
    "metadata_echo_filter": metadata_echo_filter,
    "evaluate_knn_candidates": evaluate_knn_candidates,
}


def _rf(trees, depth="null"):
    return f'{{"max_depth":{depth},"min_samples_leaf":1,"min_samples_split":2,"n_estimators":{trees}}}'


def _hgb(rate, rounds, depth="null", l2="0.0"):
    return f'{{"l2_regularization":{l2},"learning_rate":{rate},"max_depth":{depth},"max_iter":{rounds}}}'


_GROUPS_SQL = """groups AS (SELECT dataset, sum(n)::BIGINT AS n_rows, max(n) / sum(n) AS max_prior FROM (
  SELECT o_orderpriority AS dataset, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY dataset),
limits AS (SELECT *, greatest(3, least(100, floor(sqrt(n_rows) * 3)))::BIGINT AS max_k,
           least(51, greatest(5, floor(sqrt(n_rows) * 2)))::BIGINT AS k FROM groups)"""
_KNN_SQL = """'{"n_neighbors":' || CASE WHEN k BETWEEN 3 AND max_k THEN k ELSE least(31, max_k) END || ',"weights":"distance"}'"""


def _baselines_sql(balanced: str) -> str:
    return f"""baselines AS (
  SELECT dataset, 1000000 AS ord, 'rf' AS model, '{_rf(600)}' AS hp FROM limits
  UNION ALL SELECT dataset, 1000001, 'rf', '{_rf(1000, 20)}' FROM limits
  UNION ALL SELECT dataset, 1000002, 'hgb', '{_hgb(0.06, 600)}' FROM limits
  UNION ALL SELECT dataset, 1000003, 'hgb', '{_hgb(0.1, 400, 16, "1.0")}' FROM limits
  UNION ALL SELECT dataset, 1000004, 'lr', '{{"C":1.0,"class_weight":' ||
    CASE WHEN {balanced} THEN '"balanced"' ELSE 'null' END || '}}' FROM limits
  UNION ALL SELECT dataset, 1000005, 'knn', {_KNN_SQL} FROM limits)"""


ORACLES = {
    "parse_candidates": """SELECT o_orderkey, 0::BIGINT AS ord, 'rf' AS model, o_custkey AS size, 'w' AS why
          FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT o_orderkey, 1, 'lr', 2, '' FROM orders WHERE o_orderkey % 5 = 0
        UNION ALL SELECT o_orderkey, 0, 'knn', o_custkey, 'near' FROM orders WHERE o_orderkey % 5 = 1
        UNION ALL SELECT o_orderkey, 0, 'hgb', o_custkey, '' FROM orders WHERE o_orderkey % 5 = 3""",
    "sanitize_candidates": """SELECT o_orderkey,
        CASE o_orderkey % 4 WHEN 0 THEN 'rf' WHEN 1 THEN 'lr' WHEN 2 THEN 'hgb' ELSE 'knn' END AS model,
        CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 2 END::BIGINT AS n_keys,
        CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_custkey BETWEEN 0.001 AND 1000 THEN o_custkey ELSE 1 END::DOUBLE END AS "C",
        CASE WHEN o_orderkey % 4 = 1 THEN 'balanced' END AS class_weight,
        CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_custkey BETWEEN 50 AND 2000 THEN o_custkey ELSE 600 END END AS n_estimators,
        CASE WHEN o_orderkey % 4 = 2 AND o_custkey BETWEEN 1 AND 100 THEN o_custkey END AS max_depth,
        CASE WHEN o_orderkey % 4 = 2 THEN 0.06::DOUBLE END AS learning_rate,
        CASE WHEN o_orderkey % 4 = 3 THEN CASE
          WHEN CASE WHEN o_custkey BETWEEN 3 AND 100 THEN o_custkey ELSE 31 END BETWEEN 3 AND mk
          THEN CASE WHEN o_custkey BETWEEN 3 AND 100 THEN o_custkey ELSE 31 END ELSE least(31, mk) END END AS n_neighbors,
        CASE WHEN o_orderkey % 4 = 3 THEN 'distance' END AS weights
        FROM (SELECT *, greatest(3, least(100, floor(sqrt(greatest(o_custkey, 1)) * 3)))::BIGINT AS mk FROM orders)""",
    "augment_baselines": f"""WITH {_GROUPS_SQL}, {_baselines_sql("dataset[1] = '1' OR max_prior >= 0.7")}
        SELECT dataset, ord::BIGINT AS ord, model, hp FROM baselines""",
    "candidate_pool": f"""WITH {_GROUPS_SQL}, {_baselines_sql("max_prior >= 0.7")},
        proposals AS (
          SELECT DISTINCT o_orderpriority AS dataset, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS ord,
            CASE WHEN o_orderstatus = 'O' THEN 'knn' ELSE 'rf' END AS model FROM orders),
        clean AS (
          SELECT dataset, ord, model, CASE model WHEN 'rf' THEN '{_rf(600)}' ELSE
            '{{"n_neighbors":' || CASE WHEN 97 <= max_k THEN 97 ELSE least(31, max_k) END || ',"weights":"distance"}}' END AS hp
          FROM proposals JOIN limits USING (dataset)),
        pool AS (SELECT * FROM clean UNION ALL SELECT * FROM baselines)
        SELECT dataset, min(ord)::BIGINT AS ord, model, hp FROM pool GROUP BY dataset, model, hp""",
    "metadata_echo_filter": """SELECT o_orderkey, CASE o_orderkey % 3
        WHEN 1 THEN '{"model": "lr", "n": ' || o_custkey || '}' ELSE '[1, 2]' END AS block
        FROM orders WHERE o_orderkey % 3 <> 0""",
    "evaluate_knn_candidates": f"""WITH {VECTORS_SQL}, {folded_sql()}, {neighbors_sql(15)},
        votes AS (
          SELECT 0 AS ord, test_id, payload AS pred, row_number() OVER (PARTITION BY test_id ORDER BY count(*) DESC, payload) AS n
          FROM near WHERE rank <= 3 GROUP BY test_id, payload
          UNION ALL
          SELECT 1, test_id, payload, row_number() OVER (PARTITION BY test_id ORDER BY sum(1 / dist) DESC, payload)
          FROM near GROUP BY test_id, payload),
        accuracies AS (SELECT ord, fold, avg((pred = label)::INTEGER) AS a
                       FROM votes JOIN folded ON test_id = row_id WHERE n = 1 GROUP BY ord, fold)
        SELECT ord::BIGINT AS ord, round(avg(a), 6) AS score FROM accuracies GROUP BY ord""",
}
