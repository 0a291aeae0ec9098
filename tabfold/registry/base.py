"""Shared inputs of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabfold.functions.text import variant_row
from tabfold.models.overlap import overlapped
from tabfold.operators.sampling import stratified_kfold, test_rows, train_rows
from tabfold.workspace import stage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(column):
    """Both sides of a comparison round reals to six places."""
    return F.round(column, 6)


STATUS_CODE_SQL = "(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END)"


def status_code():
    return F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)


def orders_data(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """``row_id, label, features``: order status from customer and price."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        status_code().alias("label"),
        F.array(F.col("o_custkey").cast("double"), "o_totalprice").alias("features"),
        *more,
    )


ORDERS_DATA_SQL = f"""data AS (
  SELECT o_orderkey AS row_id, {STATUS_CODE_SQL} AS label,
         o_custkey::DOUBLE AS f0, o_totalprice AS f1
  FROM orders)"""


def typed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows, with a whole number, a text and a real under their own names for prompts."""
    return orders_data(spark, folder, variant_row(["o_custkey", "o_orderpriority", "o_totalprice"]).alias("row"))


TYPED_ORDERS_SQL = f"""data AS (
  SELECT o_orderkey AS row_id, {STATUS_CODE_SQL} AS label, o_custkey, o_orderpriority, o_totalprice FROM orders)"""

def ruled_data(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, label, features``: orders whose label is a rule over two columns, so the right answer is known."""
    first, second = F.col("o_custkey") % 10, F.col("o_orderkey") % 7
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        (first + second >= 8).cast("int").alias("label"),
        F.array(first.cast("double"), second.cast("double")).alias("features"),
    )


#: Every row with its label as the prediction.
RULED_SQL = """SELECT o_orderkey AS row_id, label, label::BIGINT AS pred FROM (
  SELECT *, (o_custkey % 10 + o_orderkey % 7 >= 8)::INTEGER AS label FROM orders)"""

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def customer_data(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """``row_id, label, features``: market segment from nation and balance."""
    code = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row_id"),
        code.cast("int").alias("label"),
        F.array(F.col("c_nationkey").cast("double"), "c_acctbal").alias("features"),
        *more,
    )


def typed_customers(spark: SparkSession, folder: str) -> DataFrame:
    return customer_data(spark, folder, variant_row(["c_acctbal", "c_name", "c_nationkey"]).alias("row"))


CUSTOMER_DATA_SQL = f"""data AS (
  SELECT c_custkey AS row_id, list_position({SEGMENTS}, c_mktsegment)::INTEGER AS label,
         c_nationkey::DOUBLE AS f0, c_acctbal AS f1, c_acctbal, c_name, c_nationkey
  FROM customer)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


VECTORS_SQL = "data AS (SELECT vec_id AS row_id, label, embedding::DOUBLE[] AS features FROM embeddings)"


def folded(data: DataFrame, folds: int = 5) -> DataFrame:
    return stage(stratified_kfold(data, "label", "row_id", folds), "folds")


def over_folds(data: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 5, open_fits: int = 1) -> DataFrame:
    """Results of ``predict(train, test)`` for every fold as test rows; with ``open_fits`` folds are fitted side by side."""
    dealt = folded(data, folds)
    split = lambda i: (train_rows(dealt, i).drop("fold"), test_rows(dealt, i).drop("fold"))
    jobs = [(f"fold {i}", partial(predict, *split(i))) for i in range(folds)]
    if open_fits == 1:
        return reduce(DataFrame.unionByName, [job() for _, job in jobs])
    found = overlapped(data.sparkSession, jobs, open_fits)
    for _, error in found:
        if error is not None:
            raise RuntimeError(error)
    return reduce(DataFrame.unionByName, [frame for frame, _ in found])


def folded_sql(folds: int = 5) -> str:
    """Follows a ``data`` table."""
    return f"""folded AS (
  SELECT *, ((row_number() OVER (ORDER BY label, md5('42:' || row_id::VARCHAR)) - 1) % {folds})::INTEGER AS fold
  FROM data)"""


def neighbors_sql(k: int, distance: str = "list_distance(a.features, b.features)") -> str:
    """Follows a ``folded`` table."""
    return f"""near AS (
  SELECT test_id, train_id, payload, dist, rank FROM (
    SELECT a.row_id AS test_id, b.row_id AS train_id, b.label AS payload, {distance} AS dist,
           row_number() OVER (PARTITION BY a.row_id ORDER BY {distance}, b.row_id) AS rank
    FROM folded a JOIN folded b ON a.fold <> b.fold)
  WHERE rank <= {k})"""


PLANE = "sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1))"
