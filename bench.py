"""Times the headline queries on local[BENCH_CPUS] and prints one JSON line.

Each query is run once to warm up and then timed; its result is written to the ``noop`` sink, so that all
rows are produced and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "scan_csv_positional",
    "scan_arff",
    "scan_event_jsonl",
    "one_hot_encode",
    "encode_table",
    "standardize_folds",
    "stratified_kfold",
    "stratified_cap",
    "class_prototypes",
    "knn_topk",
    "knn_vote_distance",
    "mean_accuracy",
    "column_profile",
    "schema_card",
    "rows_by_class",
    "log_summary",
    "extract_all_json",
    "parse_answer",
    "parse_candidates",
    "sanitize_candidates",
    "prompt_few_shot",
    "classify_hybrid",
    "embed_text",
    "evaluate_knn_candidates",
    "fit_logistic",
    "fit_random_forest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabfold-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tabfold.registry import all_queries

    every = all_queries()
    names = list(every) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    warm = os.environ.get("BENCH_WARMUP", "1") == "1"
    seconds: dict[str, float] = {}
    for name in names:
        for timed in (False, True) if warm else (True,):
            begin = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
