"""Text read line by line, with a dense line number where order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabfold.workspace import stage

#: Most parts of a scan.  Their starts go to every task, some hundred bytes each.
MAX_PARTS = 2_000_000
#: ``monotonically_increasing_id`` holds the number of the part above so many bits.
PART_SHIFT = 33

LOCATOR = ["_file", "_block", "_seq"]


def with_locator(scanned: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the columns of a file scan and add where each row was found."""
    return scanned.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def number_rows(located: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the 0-based position of each row in the order of files and lines.

    The scan is staged first, as a second scan may cut the files elsewhere.  Then each file block needs only its number of rows
    and its first sequence number.  A row finds its block by the part of the scan it came from, whose number it carries, so
    no row is sent anywhere, be there many small blocks or one file that cannot be split.
    """
    staged = stage(located, "rows")
    block = staged.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first")
    )
    files = block.groupBy("_file").agg(F.sum("_n").alias("_file_n"))
    earlier_files = Window.partitionBy(F.lit(1)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    earlier_blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("_before") + F.coalesce(F.sum("_n").over(earlier_blocks), F.lit(0)) - F.col("_first")
    before = files.select("_file", F.coalesce(F.sum("_file_n").over(earlier_files), F.lit(0)).alias("_before"))
    starts = block.join(before, "_file").select(
        F.shiftright("_first", PART_SHIFT).alias("_part"), F.struct(F.col("_first").alias("first"), shift.alias("shift")).alias("_start")
    )
    # a part packs a bounded number of blocks, and a block is in one part
    parts = stage(starts.groupBy("_part").agg(F.array_sort(F.collect_list("_start")).alias("_starts")), "parts")
    if parts.count() > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts of a scan: raise spark.sql.files.maxPartitionBytes")
    own = F.expr("aggregate(_starts, 0L, (a, x) -> IF(x.first <= _seq, x.shift, a))")
    placed = staged.withColumn("_part", F.shiftright("_seq", PART_SHIFT)).join(F.broadcast(parts), "_part")
    return placed.select(
        (F.col("_seq") + own).alias(name),
        *[F.col(f"`{c}`") for c in staged.columns if c not in LOCATOR],
    )


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: one row per line, in no particular order."""
    return spark.read.text(path)


def scan_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, value``: lines with their position."""
    return number_rows(with_locator(spark.read.text(path), ["value"]))
