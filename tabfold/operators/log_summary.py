"""Counts and rates from run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def event_counts(events: DataFrame, event: str = "event") -> DataFrame:
    """Rows per event type; lines without an event, or with an empty one, do not count."""
    named = events.filter(F.col(event).isNotNull() & (F.col(event) != ""))
    return named.groupBy(F.col(event).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def prediction_outcomes(events: DataFrame) -> DataFrame:
    """One row: prompts, responses, predictions marked right and wrong."""
    scored = F.col("event") == "prediction_accuracy"
    return events.agg(
        F.count_if(F.col("event") == "prompt").alias("prompts"),
        F.count_if(F.col("event") == "response").alias("responses"),
        F.count_if(scored & F.col("correct")).alias("correct"),
        F.count_if(scored & ~F.col("correct")).alias("incorrect"),
    )


def accuracy_in_line(value: Column) -> Column:
    """The number behind ``Accuracy:`` in a log line, or null."""
    digits = F.regexp_extract(value, r"Accuracy:\s([0-9.]+)", 1)
    return F.when(digits != "", digits.try_cast("double"))


def log_accuracies(numbered: DataFrame) -> DataFrame:
    """``row_id, accuracy`` for every line that reports one; the order is that of ``row_id``."""
    found = numbered.select("row_id", accuracy_in_line(F.col("value")).alias("accuracy"))
    return found.filter("accuracy is not null")


def log_accuracy_stats(lines: DataFrame) -> DataFrame:
    accuracy = accuracy_in_line(F.col("value"))
    return lines.agg(F.count(accuracy).alias("n_accuracies"), F.avg(accuracy).alias("mean_accuracy"))


def failed_parse(value: Column) -> Column:
    return value.contains("Max retries reached") | F.lower(value).contains("parsing failure")


def log_parse_failures(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(failed_parse(F.col("value"))).alias("parse_failures"))


def rate(part: Column, whole: Column) -> Column:
    """Percentage, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def log_summary(events: DataFrame, lines: DataFrame) -> DataFrame:
    """All counts and rates of a run in one row; either input may be empty."""
    outcome = prediction_outcomes(events).select(F.struct("*").alias("o"))
    accuracy = accuracy_in_line(F.col("value"))
    log = lines.agg(
        F.count(accuracy).alias("n_accuracies"),
        F.avg(accuracy).alias("mean_accuracy"),
        F.count_if(failed_parse(F.col("value"))).alias("parse_failures"),
    )
    both = log.withColumn("o", outcome.scalar()).select("o.*", *log.columns)
    return both.select(
        "*",
        (F.col("correct") + F.col("incorrect") + F.col("parse_failures")).alias("predictions"),
        rate(
            F.col("parse_failures"), F.col("correct") + F.col("incorrect") + F.col("parse_failures")
        ).alias("failure_rate"),
        rate(F.col("n_accuracies"), F.col("n_accuracies") + F.col("parse_failures")).alias("success_rate"),
    )


def sink_log_summary(summary: DataFrame, accuracies: DataFrame, events: DataFrame, path: str) -> None:
    """Text report: one line per count, per event type and per accuracy, written by the tasks."""
    names = [
        "prompts", "responses", "predictions", "correct", "incorrect", "parse_failures",
        "failure_rate", "n_accuracies", "success_rate", "mean_accuracy",
    ]
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names])
    ).alias("p")
    head = summary.select(pairs).select(F.concat_ws(": ", "p.k", F.coalesce("p.v", F.lit("none"))).alias("value"))
    by_type = event_counts(events).select(F.concat_ws(": ", F.concat(F.lit("event "), "event"), "n").alias("value"))
    # range sorting keeps the accuracies in file order over the part files
    listed = accuracies.orderBy("row_id").select(
        F.concat(F.lit("accuracy: "), F.col("accuracy").cast("string")).alias("value")
    )
    head.coalesce(1).union(by_type.coalesce(1)).union(listed).write.text(path)
