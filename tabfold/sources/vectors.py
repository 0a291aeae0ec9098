"""The table of embedded documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

VECTOR_TYPE = "id string, document string, embedding array<float>"


def sink_vector_table(df: DataFrame, path: str, group: str | None = None) -> None:
    """Replace the stored table; ``group`` is an integer column to keep."""
    own = [F.col(group).cast("bigint")] if group else []
    df.select(
        F.col("id").cast("string"), "document", F.col("embedding").cast("array<float>"), *own
    ).write.mode("overwrite").parquet(path)


def scan_vector_table(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    return spark.read.schema(f"{VECTOR_TYPE}, `{group}` bigint" if group else VECTOR_TYPE).parquet(path)
