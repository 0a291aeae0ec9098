"""Exact ranks inside large groups.

``row_number() over (partition by label ...)`` sends a whole class to one task, and one class may
hold a third of the table.  Here every group is cut into slices that follow the sort order: rows are
numbered inside a slice, and the sizes of the earlier slices, known from a small pre-aggregate, are
added.  The result is the same rank.  The number of slices follows the number of rows, so a slice stays
small however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabfold.workspace import stage

SEED = 42
FEWEST_DIGITS = 2
#: Rows that one slice, and so one sorting task, should hold at most.
ROWS_PER_SLICE = 1_000_000


def slice_digits(df: DataFrame) -> int:
    """Leading hash digits to cut by, so that even a group with all rows has slices of ``ROWS_PER_SLICE``."""
    rows, digits = df.count(), FEWEST_DIGITS
    while rows > ROWS_PER_SLICE * 16**digits:
        digits += 1
    return digits


def shuffle_key(row_id: str, seed: int = SEED) -> Column:
    """Repeatable pseudo-random sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def _group_text(columns: list[str]) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.concat_ws("\u001f", *parts)


def hash_slices(df: DataFrame, by: list[str], row_id: str, seed: int, digits: int) -> DataFrame:
    """Add ``_key`` (sort key), ``_slice`` (its leading digits) and ``_cell`` (group and slice)."""
    keyed = df.withColumn("_key", shuffle_key(row_id, seed)).withColumn(
        "_slice", F.substring("_key", 1, digits)
    )
    return keyed.withColumn("_cell", _group_text([*by, "_slice"]))


def slice_starts(sliced: DataFrame, by: list[str]) -> DataFrame:
    """Per cell: rows of the same group in earlier slices (``_start``) and in total (``_total``).

    At most groups x slices rows, whatever the size of the table.
    """
    sizes = sliced.groupBy(*by, "_slice", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *by,
        "_cell",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(group).alias("_total"),
    )


def _number_in_slices(sliced: DataFrame, starts: DataFrame, order: list[str], name: str) -> DataFrame:
    inside = Window.partitionBy("_cell").orderBy(*order)
    return (
        sliced.withColumn("_pos", F.row_number().over(inside))
        .join(starts, "_cell")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_pos", "_start")
    )


def rank_by_hash(
    df: DataFrame,
    by: list[str],
    row_id: str,
    *,
    seed: int = SEED,
    name: str = "rank",
    digits: int | None = None,
) -> DataFrame:
    """1-based rank of each row inside its group in shuffled order."""
    sliced = hash_slices(df, by, row_id, seed, slice_digits(df) if digits is None else digits)
    starts = slice_starts(sliced, by).select("_cell", "_start")
    ranked = _number_in_slices(sliced, starts, ["_key", row_id], name)
    return ranked.select(*df.columns, name)


def rank_by_value(
    df: DataFrame, by: list[str], order: str, *, name: str = "rank", slices: int | None = None
) -> DataFrame:
    """1-based rank inside each group by a unique orderable column.

    Slices are sampled ranges of the column, by default as many as keep them near ``ROWS_PER_SLICE``;
    only their balance depends on the sample, the ranks do not.
    """
    if slices is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slices = max(ranges, df.count() // ROWS_PER_SLICE + 1)
    ranged = df.repartitionByRange(slices, order).withColumn("_slice", F.spark_partition_id())
    ranged = stage(ranged, "ranged")  # the ranges must not change between the two uses
    sliced = ranged.withColumn("_cell", _group_text([*by, "_slice"]))
    starts = slice_starts(sliced, by).select("_cell", "_start")
    return _number_in_slices(sliced, starts, [order], name).select(*df.columns, name)
