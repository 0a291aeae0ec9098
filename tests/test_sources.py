import json
import os

import pytest
from pyspark.sql import functions as F

from tabfold.operators import log_summary as L
from tabfold.operators.profiling import label_counts
from tabfold.sources import arff, delimited, lines, logs, results, sidecar


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return str(path)


def test_csv_types_and_missing_words(spark, tmp_path):
    path = _write(tmp_path / "t.csv", "1,2.5,NA,True,x,7,true\n2,nan,3,False,,8,\n3,1e3,4,True,None,9,False\n")
    got = delimited.scan_csv_positional(spark, path, row_id="row_id").orderBy("row_id")
    assert got.dtypes == [
        ("row_id", "bigint"), ("0", "bigint"), ("1", "double"), ("2", "double"), ("3", "boolean"),
        ("4", "string"), ("5", "bigint"), ("6", "boolean"),
    ]
    assert [tuple(r) for r in got.collect()] == [
        (0, 1, 2.5, None, True, "x", 7, True),
        (1, 2, None, 3.0, False, None, 8, None),
        (2, 3, 1000.0, 4.0, True, None, 9, False),
    ]


def test_csv_with_header_and_separator(spark, tmp_path):
    path = _write(tmp_path / "t.csv", 'a;b c\n1;"x;y"\n2;z\n')
    assert [tuple(r) for r in delimited.scan_csv_header(spark, path, sep=";").orderBy("a").collect()] == [(1, "x;y"), (2, "z")]


def test_csv_round_trip_of_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "hi", ok', True), (2, None, False)], "a int, b string, c boolean")
    delimited.sink_csv_header(rows, f"{tmp_path}/out")
    back = delimited.scan_csv_header(spark, f"{tmp_path}/out").orderBy("a")
    assert [tuple(r) for r in back.collect()] == [(1, 'say "hi", ok', True), (2, None, False)]


def test_line_numbers_over_files_and_blocks(spark, tmp_path):
    for part in range(3):
        _write(tmp_path / "log" / f"part-{part}.txt", "".join(f"line {part * 2000 + i}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = lines.scan_numbered_lines(spark, f"{tmp_path}/log")
        assert got.count() == 6000
        assert got.filter(F.concat(F.lit("line "), "row_id") != F.col("value")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ARFF = """% made by hand
@RELATION pets

@attribute 'body weight' NUMERIC
@attribute kind {cat, 'guinea pig', "big dog"}
@attribute seen date "yyyy-MM-dd"
@data
% a comment
1.5, cat, 2020-01-02
?, 'guinea pig', ?

3, "big dog", 2021-03-04
4,?,2021-03-05
"""


def test_arff(spark, tmp_path):
    path = _write(tmp_path / "pets.arff", ARFF)
    got = arff.scan_arff(spark, path, row_id="n").orderBy("n")
    assert [(n, t) for n, t in got.dtypes] == [("n", "bigint"), ("body weight", "double"), ("kind", "string"), ("seen", "timestamp")]
    assert [(r[1], r[2], str(r[3])[:10]) for r in got.collect()] == [
        (1.5, "cat", "2020-01-02"),
        (None, "guinea pig", "None"),
        (3.0, "big dog", "2021-03-04"),
        (4.0, None, "2021-03-05"),
    ]
    kept = arff.scan_arff(spark, path, keep_question_mark=True).collect()
    assert [r["kind"] for r in kept][-1] == "?"


def test_arff_refuses_unknown_values(spark, tmp_path):
    path = _write(tmp_path / "bad.arff", "@relation r\n@attribute k {a,b}\n@data\nc\n")
    with pytest.raises(Exception, match="not in the list"):
        arff.scan_arff(spark, path).collect()
    with pytest.raises(NotImplementedError):
        arff.scan_arff(spark, _write(tmp_path / "s.arff", "@relation r\n@attribute k string\n@data\nc\n"))


def test_arff_to_csv_name(spark, tmp_path):
    path = _write(tmp_path / "pets.arff", ARFF)
    assert arff.convert_arff_csv(spark, path) == f"{tmp_path}/pets.csv"
    assert delimited.scan_csv_header(spark, f"{tmp_path}/pets.csv").count() == 4


def test_dataset_folders(spark, tmp_path):
    root = str(tmp_path)
    table = spark.range(10).select("id", (F.col("id") % 2).alias("y"), (F.col("id") * 1.5).alias("x"))
    csv, meta = sidecar.prepare_dataset(table, root, "whole", target=0, order="id", skip=2)
    _write(tmp_path / "no_meta" / "no_meta.csv", "1,2\n")
    _write(tmp_path / "no_csv" / "no_csv_metadata.json", "{}")
    _write(tmp_path / "other" / "else.csv", "1,2\n")
    got = {r["dataset"]: (r["has_csv"], r["has_metadata"], r["complete"]) for r in sidecar.dataset_catalog(spark, root).collect()}
    assert got == {"whole": (True, True, True), "no_meta": (True, False, False), "no_csv": (False, True, False)}
    row = sidecar.scan_metadata(spark, meta).first()
    assert (row["target_column_index"], row["num_features"], row["num_samples"], row["feature_indices"]) == (0, 1, 8, [1])
    read = delimited.scan_csv_positional(spark, csv)
    assert read.columns == ["0", "1"] and read.count() == 8
    wanted = spark.createDataFrame([("whole",), ("gone",)], "dataset string")
    catalog = sidecar.dataset_catalog(spark, root)
    assert [r[0] for r in sidecar.ready_datasets(catalog, wanted).collect()] == ["whole"]
    assert [r[0] for r in sidecar.skipped_datasets(catalog, wanted).collect()] == ["gone"]


def test_prepared_rows_keep_their_order(spark, tmp_path):
    """More rows than any in-memory path would take, skipped by a text key and written in order."""
    rows = spark.range(30_000).select(F.format_string("r%06d", "id").alias("key"), (F.col("id") % 2).alias("y"), "id")
    csv, _ = sidecar.prepare_dataset(rows.repartition(6), str(tmp_path), "long", target=0, order="key", skip=10_001)
    read = delimited.scan_csv_positional(spark, csv, row_id="row_id").orderBy("row_id")
    assert [r["1"] for r in read.collect()] == list(range(10_001, 30_000))


def test_arff_without_data_line(spark, tmp_path):
    path = _write(tmp_path / "cut.arff", "@relation r\n@attribute a numeric\n")
    with pytest.raises(ValueError, match="no @data line"):
        arff.scan_arff(spark, path)


def test_arff_quotes_within_quotes(spark, tmp_path):
    text = "@relation r\n@attribute a {\"it's, so\", 'say \"x\"'}\n@attribute b numeric\n@data\n\"it's, so\",1\n'say \"x\"',2\n"
    rows = arff.scan_arff(spark, _write(tmp_path / "q.arff", text)).orderBy("b").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("it's, so", 1.0), ('say "x"', 2.0)]


def test_arff_round_trip_of_quotes(spark, tmp_path):
    values = ["it's", 'a "b"', "back\\slash", "plain"]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(values)], "a string, b double")
    arff.sink_arff(df, f"{tmp_path}/out", "r", {"a": values})
    assert [r["a"] for r in arff.scan_arff(spark, f"{tmp_path}/out").orderBy("b").collect()] == values


def test_empty_dataset_folder(spark, tmp_path):
    assert sidecar.dataset_catalog(spark, str(tmp_path)).count() == 0


def test_sidecar_written_by_hand(spark, tmp_path):
    text = json.dumps({"target_column_index": 2, "num_features": 2, "num_samples": 5, "feature_indices": [0, 1]}, indent=4)
    row = sidecar.scan_metadata(spark, _write(tmp_path / "m.json", text)).first()
    assert row["target_column_index"] == 2 and row["feature_indices"] == [0, 1]


def test_event_log(spark, tmp_path):
    entries = [
        {"timestamp": "t", "level": "INFO", "message": {"event": "prompt"}},
        {"timestamp": "t", "level": "INFO", "message": {"event": "response"}},
        {"timestamp": "t", "level": "INFO", "message": "text only"},
        {"timestamp": "t", "level": "INFO", "message": {"event": "cross_validation_accuracy", "correct": True}},
        {"timestamp": "t", "level": "INFO"},
    ]
    entries += [{"message": {"event": "prediction_accuracy", "correct": i < 526}} for i in range(712)]
    entries += [{"message": {"event": "prediction_accuracy", "correct": "true"}}]
    text = "\n".join(json.dumps(e) for e in entries) + '\n{"message": {"event": "prompt"\n'
    events = logs.scan_event_jsonl(spark, _write(tmp_path / "e.jsonl", text))
    row = L.prediction_outcomes(events).first()
    assert (row["prompts"], row["responses"], row["correct"], row["incorrect"]) == (1, 1, 526, 186)
    counts = {r["event"]: r["n"] for r in L.event_counts(events).collect()}
    assert counts["prediction_accuracy"] == 713 and counts["prompt"] == 1


def test_log_summary(spark, tmp_path):
    values = ["0.8529", "0.8529", "0.8485", "0.8485", "0.8485", "0.8485", "0.8500", "0.8500"]
    text = "".join(f"2025-01-01 00:00:0{i} - INFO - KNN Fold {i} Accuracy: {v}\n" for i, v in enumerate(values))
    path = _write(tmp_path / "run.log", "start\n" + text + "continued\nAccuracy: none\n")
    events = logs.parse_events(spark.createDataFrame([], "value string"))
    summary = L.log_summary(events, logs.scan_log_text(spark, path))
    row = summary.first()
    assert row["n_accuracies"] == 8 and round(row["mean_accuracy"], 4) == 0.85
    assert row["success_rate"] == 100.0 and row["failure_rate"] == 0.0 and row["predictions"] == 0
    found = L.log_accuracies(lines.scan_numbered_lines(spark, path))
    assert [r["accuracy"] for r in found.orderBy("row_id").collect()] == [float(v) for v in values]
    L.sink_log_summary(summary, found, events, f"{tmp_path}/report")
    report = [r["value"] for r in lines.scan_numbered_lines(spark, f"{tmp_path}/report").orderBy("row_id").collect()]
    assert report[0] == "prompts: 0" and report[-8:] == [f"accuracy: {float(v)}" for v in values]


def test_empty_logs(spark):
    empty = spark.createDataFrame([], "value string")
    row = L.log_summary(logs.parse_events(empty), empty).first()
    assert row["failure_rate"] == 0.0 and row["success_rate"] == 0.0 and row["mean_accuracy"] is None


def test_parse_failures_of_both_spellings(spark):
    rows = spark.createDataFrame([("Max retries reached, stop",), ("a PARSING Failure",), ("max retries reached",)], "value string")
    assert L.log_parse_failures(rows).first()[0] == 2


def test_results_append_and_export(spark, tmp_path):
    path, csv = f"{tmp_path}/results", f"{tmp_path}/csv"
    row = spark.createDataFrame([("d", 0, "LR", 0.5, "lr", '{"C": 1, "w": null}')], results.RESULT_TYPE)
    for fresh in (True, False, False):
        results.sink_results(row, path, fresh=fresh)
    assert results.scan_results(spark, path).count() == 3
    results.export_results_csv(spark, path, csv)
    back = spark.read.csv(csv, header=True, escape='"').collect()
    assert [r["hyperparameters"] for r in back] == ['{"C": 1, "w": null}'] * 3


def test_class_counts_of_a_small_table(spark):
    rows = [(c,) for c, n in {1: 59, 2: 71, 3: 48}.items() for _ in range(n)]
    counts = {r["label"]: r["n"] for r in label_counts(spark.createDataFrame(rows, "y int"), "y").collect()}
    assert counts == {1: 59, 2: 71, 3: 48}
