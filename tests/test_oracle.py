"""Every registered query: equal to its SQL where there is one, else it yields rows."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(result, con, ORACLES[name]) > 0
    else:
        assert result.count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 <= rows[0]["mean_accuracy"] <= 1


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 0",
        "SELECT o_orderkey, o_totalprice + 0.001 AS o_totalprice FROM orders",
        "SELECT o_orderkey, o_totalprice AS price FROM orders",
        "SELECT o_orderkey, o_totalprice::VARCHAR AS o_totalprice FROM orders",
    ],
)
def test_compare_notices_differences(spark, con, sql):
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_totalprice")
    assert compare(orders, con, "SELECT o_orderkey, o_totalprice FROM orders") > 0
    with pytest.raises(AssertionError):
        compare(orders, con, sql)
