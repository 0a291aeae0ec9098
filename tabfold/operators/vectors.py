"""Vector retrieval: exact, and approximate by inverted lists or random-projection buckets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabfold.operators import quantised as Q
from tabfold.operators.neighbors import _as_doubles, _best, _Fields, _search, k_nearest
from tabfold.operators.quantised import BLOCK_ROWS, CHUNK_ROWS
from tabfold.workspace import stage


def vector_topk(
    queries: DataFrame,
    stored: DataFrame,
    k: int,
    *,
    query_id: str,
    stored_id: str,
    embedding: str,
    group: str | None = None,
    payload: str | None = None,
) -> DataFrame:
    """The k stored vectors nearest to each query by squared L2 distance (``sq_dist``)."""
    found = k_nearest(
        queries,
        stored,
        k,
        test_id=query_id,
        train_id=stored_id,
        features=embedding,
        group=group,
        payload=payload,
    )
    return found.withColumn("sq_dist", F.col("dist") * F.col("dist"))


#: Most lists of an inverted file: their centroids go to every task.
MAX_LISTS = 4096


def _listed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Each row once for each of its ``probes`` nearest lists (``_pivot``), as a code around that centroid."""
    fields = [f for f in rows.schema.fields if f.name != "features"]
    names = [f.name for f in fields] + ["_pivot", "_step", "_left_out", "_codes"]

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = Q.matrix(batch.column("features"))
            near = np.argsort(Q.distances(points, centroids), axis=1, kind="stable")[:, :probes].astype(np.int32)
            for probed in near.T:
                columns = [batch.column(f.name) for f in fields] + [pa.array(probed)]
                yield pa.RecordBatch.from_arrays(columns + Q._code_columns(points, centroids[probed]), names)

    schema = T.StructType([*fields, T.StructField("_pivot", T.IntegerType()), *Q._code_fields()])
    return stage(rows.mapInArrow(place, schema), "listed")


def _cut(rows: DataFrame, id_name: str, part: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``part``: a number for at most about ``most`` rows of one list; and the parts of each list."""
    sizes = rows.groupBy("_pivot").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts"))
    before = Window.partitionBy(F.lit(1)).orderBy("_pivot").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each list, and there are ``MAX_LISTS`` of them at most
    sizes = sizes.select("_pivot", "_parts", F.coalesce(F.sum("_parts").over(before), F.lit(0)).cast("int").alias("_first"))
    place = F.col("_first") + F.pmod(F.xxhash64(id_name), F.col("_parts")).cast("int")
    placed = rows.join(F.broadcast(sizes), "_pivot").withColumn(part, place).drop("_parts", "_first")
    return placed, sizes.select("_pivot", F.explode(F.expr("sequence(_first, _first + _parts - 1)")).alias(part))


def list_pairs(
    queries: DataFrame,
    stored: DataFrame,
    k: int,
    *,
    query_id: str,
    stored_id: str,
    embedding: str,
    lists: int | None = None,
    nprobe: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The pairs ``test_id, train_id, low, high`` that ``vector_topk_ivf`` measures, see ``measured``."""
    left = queries.select(F.col(query_id).alias("test_id"), _as_doubles(embedding))
    right = stored.select(F.col(stored_id).alias("train_id"), _as_doubles(embedding))
    count = right.count()
    lists = min(MAX_LISTS, lists or max(1, math.isqrt(count)))
    centroids = Q.pick_pivots(right, lists)
    if not len(centroids):
        nothing = F.lit(None).cast("double")
        return left.select("test_id").join(right.select("train_id").limit(0), F.lit(False)).select("*", nothing.alias("low"), nothing.alias("high"))
    probes = min(len(centroids), nprobe or max(1, len(centroids) // 8))
    postings, chunk_numbers = _cut(_listed(right, centroids, 1), "train_id", "_chunk", chunk_rows)
    asked, block_numbers = _cut(_listed(left, centroids, probes), "test_id", "_block", block_rows)
    test_type, train_type = left.schema["test_id"].dataType, right.schema["train_id"].dataType
    held = Q._packed_schema("_chunk", "train_id", train_type, False, False)
    chunks = stage(postings.groupBy("_chunk").applyInArrow(Q._pack(held, "_chunk", "train_id"), held), "chunks")
    packed = Q._packed_schema("_block", "test_id", test_type, False, False)
    blocks = stage(asked.groupBy("_block").applyInArrow(Q._pack(packed, "_block", "test_id"), packed), "blocks")
    pairs = block_numbers.join(chunk_numbers, "_pivot").select("_block", "_chunk")
    return Q.narrowed(Q._meet(blocks, chunks, pairs, centroids, k, Q.pair_schema(test_type, train_type)), k)


def vector_topk_ivf(
    queries: DataFrame,
    stored: DataFrame,
    k: int,
    *,
    query_id: str,
    stored_id: str,
    embedding: str,
    lists: int | None = None,
    nprobe: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate form over an inverted file: the k nearest among the vectors of the ``nprobe`` nearest lists.

    Lists gather the stored vectors around sampled ones (``lists`` of them, by default the square root of their number,
    ``MAX_LISTS`` at most); all are indexed.  Long lists are cut into chunks, and lists asked for by many into blocks.  Codes are
    scanned, and only pairs that they leave open are measured, so within the probed lists the answer is exact.  How many
    lists a recall takes depends on the data: few where vectors cluster, half of them where they do not.
    """
    names = dict(query_id=query_id, stored_id=stored_id, embedding=embedding)
    pairs = list_pairs(queries, stored, k, **names, lists=lists, nprobe=nprobe, chunk_rows=chunk_rows, block_rows=block_rows)
    return measured(pairs, queries, stored, k, **names)


def measured(pairs: DataFrame, queries: DataFrame, stored: DataFrame, k: int, *, query_id: str, stored_id: str, embedding: str) -> DataFrame:
    """The k nearest among ``pairs`` (of ``list_pairs``), by their vectors."""
    left = queries.select(F.col(query_id).alias("test_id"), _as_doubles(embedding))
    right = stored.select(F.col(stored_id).alias("train_id"), _as_doubles(embedding))
    fields = _Fields(left.schema["test_id"].dataType, right.schema["train_id"].dataType, None, None)
    found = Q.refine(pairs, left, right, fields.result())
    return _best(found, k).withColumn("sq_dist", F.col("dist") * F.col("dist"))


def vector_topk_lsh(
    queries: DataFrame,
    stored: DataFrame,
    k: int,
    *,
    query_id: str,
    stored_id: str,
    embedding: str,
    bucket_length: float = 1.0,
    tables: int = 8,
    width: int = 1,
    seed: int = 42,
    chunk_rows: int = CHUNK_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate form: only vectors that share a bucket in one of the hash tables are compared.

    A bucket is named by ``width`` projections; more of them make buckets smaller.  Where vectors do not cluster, tables of
    one projection meet more pairs than there are, and the exact form is cheaper.
    A bucket with many rows is cut into chunks (stored side) and blocks (query side), and each
    chunk keeps its k best, so a hot bucket costs more tasks but no large one.
    """
    left = queries.select(F.col(query_id).alias("test_id"), _as_doubles(embedding))
    right = stored.select(F.col(stored_id).alias("train_id"), _as_doubles(embedding))
    fields = _Fields(left.schema["test_id"].dataType, right.schema["train_id"].dataType, None, None)
    lsh = BucketedRandomProjectionLSH(
        inputCol="_vector", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables * width, seed=seed
    )
    as_vectors = right.withColumn("_vector", array_to_vector("features"))
    model = lsh.fit(as_vectors.limit(1))  # reads nothing but the dimension

    def bucketed(df: DataFrame) -> DataFrame:
        hashed = model.transform(df.withColumn("_vector", array_to_vector("features")))
        cells = F.transform("_hashes", lambda h: vector_to_array(h)[0].cast("bigint"))
        one = lambda t: F.concat_ws("/", t, F.array_join(F.slice(cells, t * width + 1, width).cast("array<string>"), "/"))
        keys = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), one)
        return hashed.withColumn("_bucket", F.explode(keys)).drop("_vector", "_hashes")

    # staged: counted first, then searched
    left = stage(bucketed(left), "lsh-queries")
    right = stage(bucketed(right), "lsh-stored")
    pieces = right.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_chunks"))
    blocks = left.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    plan = pieces.join(blocks, "_bucket")

    own_block = F.pmod(F.xxhash64("test_id"), F.col("_blocks"))
    own_chunk = F.pmod(F.xxhash64("train_id"), F.col("_chunks"))
    asked = (
        left.join(plan, "_bucket")
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
        .select("test_id", "features", F.concat_ws(":", "_bucket", "_chunk", own_block).alias("cell"))
    )
    held = (
        right.join(plan, "_bucket")
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select("train_id", "features", F.concat_ws(":", "_bucket", own_chunk, "_block").alias("cell"))
    )
    found = _search(asked, held, fields, k)
    # the same pair may be met in several tables
    once = Window.partitionBy("test_id", "train_id").orderBy("dist")
    found = found.withColumn("_n", F.row_number().over(once)).filter(F.col("_n") == 1).drop("_n")
    return _best(found, k).withColumn("sq_dist", F.col("dist") * F.col("dist"))
