"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tabfold.workspace import stage

#: Multiplier of the generator of jump hashing. Fixed value.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; going from n to n + 1 shards moves keys only into shard n."""
    if shards < 1:
        raise ValueError("at least one shard")
    state = keys.astype(np.uint64)
    out = np.full(len(keys), -1, np.int64)
    leap = np.zeros(len(keys), np.int64)
    active = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(active):
            out[active] = leap[active]
            state[active] = state[active] * np.uint64(MULTIPLIER) + np.uint64(1)
            draw = ((state[active] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            leap[active] = ((out[active] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            active = active[leap[active] < shards]
    return out


def jump_column(key: Column, shards: int) -> Column:
    """``jump`` of a whole-number column; a null key counts as 0."""

    @pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The key and the number of shards decide; ``grown_shard`` is the shard with one more.  ``size`` is the
    UTF-8 length plus 1, a null text has length 0.  Slots number the rows of a shard from 0 in the order of
    the key (null first), then checksum and size; equal rows are numbered in any order.  Rows are sorted
    by sampled ranges of that order, and the counts of earlier ranges are added, so no shard is sorted whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key_col).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = rows.select(
        "*",
        jump_column(F.col("key"), shards).alias("shard"),
        jump_column(F.col("key"), shards + 1).alias("grown_shard"),
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "text_crc32", "size"]
    ranged = rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "sharded")  # the ranges must not change between the two uses
    counts = ranged.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard", "part").orderBy(*order)
    placed = ranged.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["shard", "part"])
    return placed.select(
        F.col("key").alias(key_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("rank") + F.col("ahead")).cast("long").alias("slot"),
        "grown_shard",
    )

