"""Joins with popular keys."""

from pyspark.sql import functions as F

from tabfold.operators.joins import POPULAR_KEYS, join_popular, popular


def test_join_popular_equals_a_plain_join(spark):
    left = spark.createDataFrame([(i, i % 7 if i % 3 else 100) for i in range(600)] + [(900, None)], "x int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in [0, 1, 2, 3, 100, 101]] + [(None, "none")], "k int, v string")
    sizes = left.groupBy("k").agg(F.count("*").alias("n"))
    right = right.join(sizes, "k", "left")
    want = sorted(map(tuple, left.join(right, "k").select("x", "k", "v").collect()))
    for rule in (F.col("n") > 100, popular(F.col("n"), 600), F.lit(False), F.lit(True)):
        got = join_popular(left, right, ["k"], rule).select("x", "k", "v").collect()
        assert sorted(map(tuple, got)) == want


def test_popular_keys_are_bounded(spark):
    keys = spark.range(5 * POPULAR_KEYS).select((F.col("id") % (2 * POPULAR_KEYS)).alias("k")).groupBy("k").count()
    assert keys.where(popular(F.col("count"), 5 * POPULAR_KEYS)).count() <= POPULAR_KEYS
