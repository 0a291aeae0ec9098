"""Dataset folders: ``<name>/<name>.csv`` beside ``<name>/<name>_metadata.json``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabfold.operators.cleaning import positional_rename, skip_rows
from tabfold.sources.delimited import sink_csv_positional

METADATA_TYPE = (
    "target_column_index int, num_features int, num_samples bigint, feature_indices array<int>"
)


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_TYPE).json(path, multiLine=True)


def build_metadata(df: DataFrame, target: int) -> DataFrame:
    """One row: target position, feature count, row count, all positions but the target."""
    width = len(df.columns)
    if not 0 <= target < width:
        raise IndexError(f"no column at position {target}")
    positions = F.sequence(F.lit(0), F.lit(width - 1))
    return df.agg(F.count(F.lit(1)).alias("num_samples")).select(
        F.lit(target).alias("target_column_index"),
        F.lit(width - 1).alias("num_features"),
        "num_samples",
        F.array_except(positions, F.array(F.lit(target))).alias("feature_indices"),
    )


def sink_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.json(path)  # one row


def prepare_dataset(
    df: DataFrame, folder: str, name: str, *, target: int, order: str, skip: int = 0
) -> tuple[str, str]:
    """Skip rows, drop names, write the headerless table and its sidecar; returns both paths.

    ``order`` is the row id by which rows are skipped and written, in sorted ranges; it is not written itself.
    """
    kept = skip_rows(df, skip, order)
    table = positional_rename(kept.orderBy(order).drop(order))
    csv, sidecar = f"{folder}/{name}/{name}.csv", f"{folder}/{name}/{name}_metadata.json"
    sink_csv_positional(table, csv)
    sink_metadata(build_metadata(table, target), sidecar)
    return csv, sidecar


def dataset_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """``dataset, has_csv, has_metadata, complete`` for each dataset folder.

    Lists file names only; no content is read.
    """
    found = None
    for pattern in ("*/*.csv", "*/*_metadata.json"):
        try:
            part = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{pattern}").select("path")
        except Exception as error:  # the pattern matches nothing
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "path string")
    # the file name repeats the folder name; a table written by Spark is a folder of part files
    name = r"/([^/]+)/\1(\.csv|_metadata\.json)(?:/|$)"
    return (
        found.select(
            F.regexp_extract("path", name, 1).alias("dataset"), F.regexp_extract("path", name, 2).alias("kind")
        )
        .filter("dataset <> ''")
        .groupBy("dataset")
        .agg(
            F.bool_or(F.col("kind") == ".csv").alias("has_csv"),
            F.bool_or(F.col("kind") != ".csv").alias("has_metadata"),
        )
        .withColumn("complete", F.col("has_csv") & F.col("has_metadata"))
    )


def ready_datasets(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(catalog.filter("complete"), "dataset", "left_semi")


def skipped_datasets(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(catalog.filter("complete"), "dataset", "left_anti")
