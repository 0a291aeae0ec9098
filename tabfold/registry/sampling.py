"""Folds, caps, prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import sampling as S
from tabfold.registry.base import (
    ORDERS_DATA_SQL,
    VECTORS_SQL,
    folded,
    folded_sql,
    orders_data,
    table,
    vectors,
)


def stratified_kfold(spark, folder):
    dealt = S.stratified_kfold(orders_data(spark, folder), "label", "row_id", 5)
    return dealt.select("row_id", F.col("fold").cast("bigint").alias("fold"))


def fold_split(spark, folder):
    roles = S.fold_roles(folded(vectors(spark, folder)), 5)
    return roles.select("row_id", F.col("split").cast("bigint").alias("split"), "role")


def stratified_cap(spark, folder):
    capped = S.stratified_cap(table(spark, folder, "orders"), "o_orderpriority", "o_orderkey", 5000)
    return capped.select("o_orderkey", "o_orderpriority")


def class_prototypes(spark, folder):
    picked = S.class_prototypes(vectors(spark, folder), "label", "row_id", per_class=2, max_examples=15)
    return picked.select("row_id", F.col("label").cast("bigint").alias("label"), F.col("position").cast("bigint").alias("position"))


def context_sample(spark, folder):
    return S.context_sample(table(spark, folder, "orders"), "o_orderkey", 50).select("o_orderkey", "o_totalprice")


QUERIES = {
    "stratified_kfold": stratified_kfold,
    "fold_split": fold_split,
    "stratified_cap": stratified_cap,
    "class_prototypes": class_prototypes,
    "context_sample": context_sample,
}

ORACLES = {
    "stratified_kfold": f"WITH {ORDERS_DATA_SQL}, {folded_sql()} SELECT row_id, fold::BIGINT AS fold FROM folded",
    "fold_split": f"""WITH {VECTORS_SQL}, {folded_sql()}
        SELECT row_id, split, CASE WHEN fold = split THEN 'test' ELSE 'train' END AS role
        FROM folded CROSS JOIN (SELECT range AS split FROM range(5))""",
    "stratified_cap": """SELECT o_orderkey, o_orderpriority FROM (
        SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c,
               row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey::VARCHAR)) AS r
        FROM orders)
        WHERE r <= CASE WHEN n > 5000 THEN greatest(1, round_even(c * (5000.0::DOUBLE / n), 0)) ELSE c END""",
    "class_prototypes": """WITH ranked AS (
        SELECT vec_id, label, md5('42:' || vec_id::VARCHAR) AS h,
               row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id::VARCHAR)) AS r FROM embeddings)
        SELECT vec_id AS row_id, label::BIGINT AS label, row_number() OVER (ORDER BY h) AS position
        FROM ranked WHERE r <= 2 ORDER BY h LIMIT 15""",
    "context_sample": """SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY md5('42:' || o_orderkey::VARCHAR) LIMIT 50""",
}
