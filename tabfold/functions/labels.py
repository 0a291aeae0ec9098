"""Labels as 0..n-1 and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MAX_CLASSES = 100_000


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``label, code`` in the order of the label values, one row per class."""
    distinct = df.select(F.col(label).alias("label")).filter(F.col(label).isNotNull()).distinct()
    distinct = distinct.limit(MAX_CLASSES + 1)  # no more than these are numbered in one task
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("label"))
    return distinct.select("label", (place - 1).alias("code")).withColumn(
        "code",
        F.when(F.col("code") < MAX_CLASSES, F.col("code")).otherwise(
            F.raise_error(F.lit(f"more than {MAX_CLASSES} classes"))
        ),
    )


def encode_labels(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """Add ``code``, null for a null or unknown label.  Spark broadcasts the code table after checking its size."""
    named = codes.withColumnRenamed("label", "_label")
    return df.join(named, F.col(label) == F.col("_label"), "left").drop("_label")


def decode_labels(df: DataFrame, code: str, codes: DataFrame, name: str) -> DataFrame:
    small = codes.select(F.col("label").alias(name), F.col("code").alias("_code"))
    return df.join(small, F.col(code).cast("int") == F.col("_code"), "left").drop("_code")
