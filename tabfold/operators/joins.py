"""Joins whose keys are uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Popular keys are those with more than one in this many rows, so there are no more of them than this.
POPULAR_KEYS = 1000


def popular(count: Column, total: int) -> Column:
    """Whether a key with ``count`` of ``total`` rows is popular; fewer than ``POPULAR_KEYS`` keys can be."""
    return count * POPULAR_KEYS > total


def join_popular(left: DataFrame, right: DataFrame, on: list[str], is_popular: Column) -> DataFrame:
    """Inner join of ``left`` with ``right``, whose keys ``on`` are unique and of which ``is_popular`` marks a few.

    Rows of popular keys meet them in a broadcast join, the others in a shuffled one, so no task receives all rows of a
    popular key.  ``is_popular`` must hold for a bounded number of rows, as ``popular`` does.  ``left`` is read twice:
    stage a costly one.  Null keys match nothing.
    """
    marked = right.withColumn("_popular", F.coalesce(is_popular, F.lit(False)))
    few = marked.where("_popular").drop("_popular")
    many = marked.where("NOT _popular").drop("_popular")
    met = left.join(F.broadcast(few), on)
    rest = left.join(F.broadcast(few.select(*on)), on, "left_anti").join(many, on)
    return met.unionByName(rest)
