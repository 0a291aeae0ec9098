"""Projections, filters, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import cleaning as C
from tabfold.registry.base import (
    ORDERS_DATA_SQL,
    STATUS_CODE_SQL,
    folded,
    folded_sql,
    orders_data,
    r6,
    status_code,
    table,
)


def split_target(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", status_code().alias("status"), "o_totalprice"
    )
    split = C.split_target(orders, 1, carry=["o_orderkey"])
    return split.select(
        "o_orderkey", F.col("label").cast("bigint").alias("label"), *[F.col("features")[i].alias(f"f{i}") for i in (0, 1)]
    )


def drop_by_position(spark, folder):
    return C.drop_by_position(C.drop_by_position(table(spark, folder, "customer"), 1), 99)


def positional_rename(spark, folder):
    return C.positional_rename(table(spark, folder, "customer"))


def skip_rows(spark, folder):
    return C.skip_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 100, "o_orderkey")


def head_fraction(spark, folder):
    return C.head_fraction(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), 0.3, "o_orderkey")


def bool_text_to_int(spark, folder):
    flag = F.when(F.col("l_returnflag") == "R", "True").when(F.col("l_returnflag") == "A", "False")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", flag.alias("flag"), "l_linestatus")
    return C.bool_text_to_int(rows).withColumn("flag", F.col("flag").cast("bigint"))


def bool_to_int(spark, folder):
    rows = table(spark, folder, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") > 250000).alias("large"),
        (F.col("o_orderstatus") == "F").alias("done"),
    )
    return C.bool_to_int(rows)


def one_hot_encode(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return C.one_hot_encode(rows)


def threshold_binarize(spark, folder):
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price")
    return C.threshold_binarize(table(spark, folder, "orders").select("o_orderkey", price), 1, 200000.0)


def encode_table(spark, folder):
    customer = table(spark, folder, "customer").select(
        "*",
        F.when(F.col("c_acctbal") > 5000, "True").otherwise("False").alias("rich"),
        F.when(F.col("c_nationkey") > 5, F.col("c_nationkey") > 12).alias("far"),
    )
    return C.encode_table(customer, remove=1, target=2, threshold=1000)


def head_records_json(spark, folder):
    head = C.head_records_json(
        table(spark, folder, "orders"), 10, "o_orderkey", ["o_orderkey", "o_totalprice", "o_orderstatus"]
    )
    back = F.from_json("record", "o_orderkey bigint, o_totalprice double, o_orderstatus string")
    return head.select(F.col("position").cast("bigint").alias("position"), back.alias("r")).select("position", "r.*")


def standardize(spark, folder):
    data = orders_data(spark, folder)
    scaled = C.standardize(data, data)
    return scaled.select("row_id", *[r6(F.col("features")[i]).alias(f"z{i}") for i in (0, 1)])


def standardize_folds(spark, folder):
    scaled = C.standardize_folds(folded(orders_data(spark, folder)), 5)
    return scaled.select(
        "row_id",
        F.col("split").cast("bigint").alias("split"),
        "role",
        *[r6(F.col("features")[i]).alias(f"z{i}") for i in (0, 1)],
    )


QUERIES = {
    "split_target": split_target,
    "drop_by_position": drop_by_position,
    "positional_rename": positional_rename,
    "skip_rows": skip_rows,
    "head_fraction": head_fraction,
    "bool_text_to_int": bool_text_to_int,
    "bool_to_int": bool_to_int,
    "one_hot_encode": one_hot_encode,
    "threshold_binarize": threshold_binarize,
    "encode_table": encode_table,
    "head_records_json": head_records_json,
    "standardize": standardize,
    "standardize_folds": standardize_folds,
}


def _dummies(column: str, values: list[str]) -> str:
    return ", ".join(f"""({column} = '{v}')::INTEGER AS "{column}_{v}\"""" for v in values)


ORACLES = {
    "split_target": f"""SELECT o_orderkey, {STATUS_CODE_SQL}::BIGINT AS label, o_custkey::DOUBLE AS f0,
        o_totalprice AS f1 FROM orders""",
    "drop_by_position": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "positional_rename": """SELECT c_custkey AS "0", c_name AS "1", c_nationkey AS "2", c_acctbal AS "3",
        c_mktsegment AS "4" FROM customer""",
    "skip_rows": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey OFFSET 100",
    "head_fraction": """SELECT o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM orders)
        WHERE n <= floor(total * 0.3::DOUBLE)""",
    "bool_text_to_int": """SELECT l_orderkey, l_linenumber,
        CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END::BIGINT AS flag, l_linestatus FROM lineitem""",
    "bool_to_int": """SELECT o_orderkey, (o_totalprice > 250000)::INTEGER AS large,
        (o_orderstatus = 'F')::INTEGER AS done FROM orders""",
    "one_hot_encode": f"""SELECT o_orderkey,
        {_dummies("o_orderpriority", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])},
        {_dummies("o_orderstatus", ["O", "P"])} FROM orders""",
    "threshold_binarize": """SELECT o_orderkey,
        (o_orderkey % 5 <> 0 AND o_totalprice >= 200000)::INTEGER AS price FROM orders""",
    "encode_table": f"""SELECT c_custkey, c_nationkey, (c_acctbal >= 1000)::INTEGER AS c_acctbal,
        (c_acctbal > 5000)::INTEGER AS rich,
        {_dummies("c_mktsegment", ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])},
        (c_nationkey > 5 AND c_nationkey > 12)::INTEGER AS "far_True" FROM customer""",
    "head_records_json": """SELECT row_number() OVER (ORDER BY o_orderkey) AS position, o_orderkey, o_totalprice,
        o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100""",
    "standardize": f"""WITH {ORDERS_DATA_SQL},
        s AS (SELECT avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1 FROM data)
        SELECT row_id, round((f0 - m0) / s0, 6) AS z0, round((f1 - m1) / s1, 6) AS z1 FROM data, s""",
    "standardize_folds": f"""WITH {ORDERS_DATA_SQL}, {folded_sql()},
        splits AS (SELECT range AS split FROM range(5)),
        s AS (SELECT split, avg(f0) AS m0, stddev_pop(f0) AS s0, avg(f1) AS m1, stddev_pop(f1) AS s1
              FROM folded JOIN splits ON fold <> split GROUP BY split)
        SELECT row_id, split, CASE WHEN fold = split THEN 'test' ELSE 'train' END AS role,
               round((f0 - m0) / s0, 6) AS z0, round((f1 - m1) / s1, 6) AS z1
        FROM folded CROSS JOIN s""",
}
