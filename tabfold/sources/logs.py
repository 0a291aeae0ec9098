"""Run logs: JSON lines and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabfold.sources.lines import scan_lines


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """``timestamp, level, event, correct`` of each line whose ``message`` is an object.

    Broken lines and lines with a plain text message fall out.  ``correct`` is set only by a real
    JSON boolean.
    """
    entry = lines.select(F.try_parse_json(F.col(value)).alias("j")).filter("j is not null")
    entry = entry.withColumn("m", F.try_variant_get("j", "$.message", "variant"))
    flag = F.try_variant_get("m", "$.correct", "variant")
    kept = entry.filter(F.schema_of_variant("m").startswith("OBJECT"))
    event = F.try_variant_get("m", "$.event", "variant")
    return kept.select(
        F.try_variant_get("j", "$.timestamp", "string").alias("timestamp"),
        F.try_variant_get("j", "$.level", "string").alias("level"),
        F.when(F.schema_of_variant(event) == "STRING", F.try_variant_get("m", "$.event", "string")).alias(
            "event"
        ),
        F.when(F.schema_of_variant(flag) == "BOOLEAN", F.try_variant_get("m", "$.correct", "boolean")).alias(
            "correct"
        ),
    )


def scan_event_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(scan_lines(spark, path))


def scan_log_text(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of a log, continuation lines as they are."""
    return scan_lines(spark, path)
