"""Exact k nearest neighbours and the votes taken over them.

Training rows that fit one chunk are compared with blocks of test rows at once, and only the k best per test row leave a
task.  Larger tables are scanned by compact codes first, see ``quantised``; the result is the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabfold.operators.joins import join_popular, popular
from tabfold.operators.quantised import BLOCK_ROWS, CHUNK_ROWS, matrix, refine, scan
from tabfold.workspace import stage

PAIRS_PER_BLOCK = 1 << 23
_PAIRS_PER_STEP = 1 << 21
_ROWS_PER_RANKING = 16
_PAIRS_PER_MEASURE = 8192


def best_in_chunk(
    test: np.ndarray,
    train: np.ndarray,
    k: int,
    test_group: np.ndarray | None = None,
    train_group: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test index, train index, distance) of the k nearest train rows per test row.

    ``train`` must be in tie order.  A fast inner-product pass keeps whatever could be among the k
    best within its rounding error; those few are then measured exactly.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(test) or not len(train):
        return none, none, np.zeros(0)
    k = min(k, len(train))
    norms = np.einsum("ij,ij->i", train, train)
    error = 4.0 * (train.shape[1] + 8) * np.finfo(np.float64).eps
    step = max(1, _PAIRS_PER_STEP // len(train))
    out_test, out_train, out_dist = [], [], []
    for begin in range(0, len(test), step):
        block = test[begin : begin + step]
        own = np.einsum("ij,ij->i", block, block)
        # in place: these matrices are most of what a worker holds
        rough = block @ train.T
        rough *= -2.0
        rough += own[:, None]
        rough += norms[None, :]
        if test_group is not None:
            rough[test_group[begin : begin + step, None] == train_group[None, :]] = np.inf
        slack = error * (own + norms.max())
        bound = np.empty(len(block))
        for at in range(0, len(block), _ROWS_PER_RANKING):
            bound[at : at + _ROWS_PER_RANKING] = np.partition(rough[at : at + _ROWS_PER_RANKING], k - 1, axis=1)[:, k - 1]
        bound += 2.0 * slack
        # an infinite bound leaves open all that is finite
        i, j = np.nonzero(rough <= np.minimum(bound, np.finfo(np.float64).max)[:, None])
        del rough
        squared = np.empty(len(i))
        for at in range(0, len(i), _PAIRS_PER_MEASURE):
            gap = block[i[at : at + _PAIRS_PER_MEASURE]]
            gap -= train[j[at : at + _PAIRS_PER_MEASURE]]
            gap *= gap
            squared[at : at + _PAIRS_PER_MEASURE] = gap.sum(axis=1)
        dist = np.sqrt(squared)
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out_test.append(i[keep] + begin)
        out_train.append(j[keep])
        out_dist.append(dist[keep])
    return np.concatenate(out_test), np.concatenate(out_train), np.concatenate(out_dist)


@dataclass
class _Fields:
    """Types of the columns that travel through the search."""

    test_id: T.DataType
    train_id: T.DataType
    group: T.DataType | None
    payload: T.DataType | None
    with_features: bool = False

    def result(self) -> T.StructType:
        fields = [
            T.StructField("test_id", self.test_id),
            T.StructField("train_id", self.train_id),
            T.StructField("dist", T.DoubleType()),
        ]
        if self.payload is not None:
            fields.append(T.StructField("payload", self.payload))
        if self.with_features:
            fields.append(T.StructField("train_features", T.ArrayType(T.DoubleType())))
        return T.StructType(fields)


def _compare(schema: T.StructType, k: int, grouped: bool):
    names = schema.names

    def kernel(test: pa.Table, train: pa.Table) -> pa.Table:
        # one string and one number column sort alike here, so ties fall to the smaller id
        train = train.sort_by("train_id")
        groups = (None, None)
        if grouped:
            groups = (test["grp"].to_numpy(), train["grp"].to_numpy())
        i, j, dist = best_in_chunk(matrix(test["features"]), matrix(train["features"]), k, *groups)
        found = train.take(pa.array(j))
        columns = {
            "test_id": test["test_id"].take(pa.array(i)),
            "train_id": found["train_id"],
            "dist": pa.array(dist),
        }
        if "payload" in names:
            columns["payload"] = found["payload"]
        if "train_features" in names:
            columns["train_features"] = found["features"]
        pa.default_memory_pool().release_unused()  # the worker's next cell may be larger
        return pa.table({n: columns[n] for n in names})

    return kernel


def _search(visits: DataFrame, chunks: DataFrame, fields: _Fields, k: int) -> DataFrame:
    """Compare test rows (``cell``, test columns) with train rows (``cell``, train columns)."""
    kernel = _compare(fields.result(), k, fields.group is not None)
    return visits.groupBy("cell").cogroup(chunks.groupBy("cell")).applyInArrow(kernel, fields.result())


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("test_id").orderBy("dist", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _as_doubles(features: str):
    return F.col(features).cast("array<double>").alias("features")


def k_nearest(
    test: DataFrame,
    train: DataFrame,
    k: int,
    *,
    test_id: str,
    train_id: str,
    features: str = "features",
    payload: str | None = None,
    group: str | None = None,
    with_features: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest train rows of every test row: ``test_id, train_id, dist, rank[, payload]``.

    Euclidean distance on the raw features, ties to the smaller ``train_id``.  ``payload`` is a train
    column to carry along (a label), ``with_features`` adds the neighbour's ``train_features``; neither
    needs a join, which popular neighbours would skew.  With ``group``, an integer column of both frames, rows of equal
    group are not compared: on a table with its fold number this searches every fold's training part
    in one job.  Both frames are read more than once; stage them if they are costly to compute.
    """
    group_column = [F.col(group).cast("bigint").alias("grp")] if group else []
    left = test.select(F.col(test_id).alias("test_id"), _as_doubles(features), *group_column)
    right = train.select(
        F.col(train_id).alias("train_id"),
        _as_doubles(features),
        *group_column,
        *([F.col(payload).alias("payload")] if payload else []),
    )
    fields = _Fields(
        left.schema["test_id"].dataType,
        right.schema["train_id"].dataType,
        left.schema["grp"].dataType if group else None,
        right.schema["payload"].dataType if payload else None,
        with_features,
    )
    train_count = right.count()
    test_count = left.count()
    if train_count <= chunk_rows:
        # enough blocks to use the cluster, and none larger than a block may be
        spread = min(4 * test.sparkSession.sparkContext.defaultParallelism, test_count * train_count // PAIRS_PER_BLOCK)
        blocks = max(1, spread, math.ceil(test_count / block_rows))
        cell = F.pmod(F.xxhash64("test_id"), F.lit(blocks)).alias("cell")
        copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("cell")
        found = _search(left.select("*", cell), right.select("*", copies), fields, k)
        return _best(found, k)
    # rows of equal features and group have equal neighbours: one of them is searched for all
    key = F.struct(*[c for c in left.columns if c != "test_id"]).alias("_key")
    asked = left.select("test_id", key).groupBy("_key").agg(F.min("test_id").alias("test_id"), F.count(F.lit(1)).alias("_rows"))
    asked = stage(asked.select("test_id", "_key.*", "_rows"), "asked")
    if asked.count() * 2 > test_count:
        return _best(_scanned(left, right, k, train_count, chunk_rows, block_rows, fields), k)
    found = _best(_scanned(asked.drop("_rows"), right, k, train_count, chunk_rows, block_rows, fields), k)
    names = [c for c in found.columns if c != "test_id"]
    lists = found.groupBy("test_id").agg(F.collect_list(F.struct(*names)).alias("_found"))
    lists = stage(asked.select("test_id", key, "_rows").join(lists, "test_id").drop("test_id"), "found")
    members = join_popular(left.select("test_id", key), lists, ["_key"], popular(F.col("_rows"), test_count))
    return members.select("test_id", F.explode("_found").alias("_one")).select("test_id", "_one.*")


def _scanned(left: DataFrame, right: DataFrame, k: int, train_count: int, chunk_rows: int, block_rows: int, fields: _Fields) -> DataFrame:
    pairs = scan(left, right, k, train_count, chunk_rows, block_rows)
    return refine(pairs, left, right, fields.result())


def vote_uniform(neighbors: DataFrame) -> DataFrame:
    """Most frequent label among the neighbours, ties to the smallest: ``test_id, pred``."""
    votes = neighbors.groupBy("test_id", F.col("payload").alias("pred")).agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return _winner(votes)


def vote_distance(neighbors: DataFrame) -> DataFrame:
    """Label with the largest sum of 1/distance; neighbours at distance 0 outvote all others."""
    nearest = F.min("dist").over(Window.partitionBy("test_id"))
    weight = F.when(nearest == 0, (F.col("dist") == 0).cast("double")).otherwise(1 / F.col("dist"))
    votes = (
        neighbors.withColumn("w", weight)
        .groupBy("test_id", F.col("payload").alias("pred"))
        .agg(F.sum("w").alias("weight"))
    )
    return _winner(votes)


def _winner(votes: DataFrame) -> DataFrame:
    order = Window.partitionBy("test_id").orderBy(F.desc("weight"), "pred")
    return (
        votes.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") == 1)
        .select("test_id", "pred")
    )


def neighbor_rows(neighbors: DataFrame, train: DataFrame, train_id: str, columns: list[str]) -> DataFrame:
    """Join further train columns to each neighbour.

    A train row near to many test rows would send them all to one task: such rows, found by a count, are
    broadcast, see ``join_popular``.  The neighbours are written once, as they are counted and joined.
    """
    neighbors = stage(neighbors.drop("payload"), "neighbours")
    asked = neighbors.groupBy("train_id").agg(F.count(F.lit(1)).alias("_asked"))
    wanted = train.select(F.col(train_id).alias("train_id"), *columns).join(asked, "train_id")
    return join_popular(neighbors, wanted, ["train_id"], popular(F.col("_asked"), neighbors.count())).drop("_asked")


def neighbor_lists(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per test row with its k neighbours as an array, nearest first."""
    entry = F.struct("rank", "train_id", "dist", *columns)
    return rows.groupBy("test_id").agg(F.array_sort(F.collect_list(entry)).alias("neighbors"))
