"""Result rows of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RESULT_TYPE = (
    "dataset string, fold int, method string, accuracy double, model string, hyperparameters string"
)


def _as_result(df: DataFrame) -> DataFrame:
    fields = [f.strip().split(" ") for f in RESULT_TYPE.split(",")]
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]
    )


def sink_results(df: DataFrame, path: str, *, fresh: bool = False) -> None:
    """Append result rows; ``fresh`` starts the table anew."""
    _as_result(df).write.mode("overwrite" if fresh else "append").parquet(path)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_TYPE).parquet(path)


def export_results_csv(spark: SparkSession, path: str, csv: str) -> None:
    """CSV with quotes around the hyperparameters, whose commas would break it otherwise."""
    scan_results(spark, path).write.csv(csv, header=True, quoteAll=True, escape='"')
