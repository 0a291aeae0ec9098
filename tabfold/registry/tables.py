"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tabfold.operators.cleaning import categories
from tabfold.registry.base import r6, table, vectors
from tabfold.registry.prompted import hash_embedder
from tabfold.sources import arff, delimited, logs, results, sidecar
from tabfold.sources.lines import scan_numbered_lines
from tabfold.plans.prompting import build_vector_table
from tabfold.workspace import new_folder


def _gappy_orders(spark, folder):
    price = F.when(F.col("o_orderkey") % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", price.alias("price"))


def scan_csv_positional(spark, folder):
    path = new_folder(spark, "csv")
    delimited.sink_csv_positional(_gappy_orders(spark, folder), path)
    return delimited.scan_csv_positional(spark, path).toDF("c0", "c1", "c2")


def sink_csv_positional(spark, folder):
    path = new_folder(spark, "csv")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    delimited.sink_csv_positional(orders, path)
    types = {"0": T.LongType(), "1": T.StringType(), "2": T.DoubleType()}
    return delimited.scan_csv_positional(spark, path, types=types).toDF("c0", "c1", "c2")


def scan_csv_header(spark, folder):
    path = new_folder(spark, "csv")
    delimited.sink_csv_header(table(spark, folder, "customer"), path, sep=";")
    return delimited.scan_csv_header(spark, path, sep=";")


def _part_arff(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey",
        "p_type",
        "p_brand",
        F.when(F.col("p_size") != 10, F.col("p_size")).alias("p_size"),
        "p_retailprice",
    )
    path = new_folder(spark, "arff") + ".arff"
    arff.sink_arff(part, path, "part", categories(part, ["p_type", "p_brand"]))
    return path


def scan_arff(spark, folder):
    return arff.scan_arff(spark, _part_arff(spark, folder))


def convert_arff_csv(spark, folder):
    return delimited.scan_csv_header(spark, arff.convert_arff_csv(spark, _part_arff(spark, folder)))


def _metadata_rows(metadata):
    return metadata.select(
        F.col("target_column_index").cast("bigint").alias("target_column_index"),
        F.col("num_features").cast("bigint").alias("num_features"),
        "num_samples",
        F.explode(F.col("feature_indices").cast("array<bigint>")).alias("feature_index"),
    )


def build_metadata(spark, folder):
    return _metadata_rows(sidecar.build_metadata(table(spark, folder, "orders"), 2))


def scan_metadata(spark, folder):
    path = new_folder(spark, "metadata")
    sidecar.sink_metadata(sidecar.build_metadata(table(spark, folder, "orders"), 2), path)
    return _metadata_rows(sidecar.scan_metadata(spark, path))


def event_lines(spark, folder):
    """Log lines: most with an object as message, every fifth with text, some broken."""
    message = F.to_json(
        F.struct(
            F.col("event_type").alias("event"), (F.col("value") > 250).alias("correct"), "user_id"
        )
    )
    fifth = F.col("event_id") % 5 == 0
    text = F.when(fifth, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(message)
    line = F.concat(
        F.lit('{"timestamp": "t'), "event_id", F.lit('", "level": "INFO", "message": '), text, F.lit("}")
    )
    return table(spark, folder, "events").select(
        F.when(F.col("event_id") % 11 == 0, F.substring_index(line, "message", 1)).otherwise(line).alias("value")
    )


def scan_event_jsonl(spark, folder):
    path = new_folder(spark, "events")
    event_lines(spark, folder).write.text(path)
    return logs.scan_event_jsonl(spark, path)


EVENTS_SQL = """read AS (
  SELECT 't' || event_id AS timestamp, 'INFO' AS level, event_type AS event, value > 250 AS correct
  FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0)"""


def log_lines(spark, folder):
    """One log line per order, in key order: accuracies, failures of two spellings, other text."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 3 == 0, F.concat(F.lit("KNN Fold 1 Accuracy: 0."), F.lpad((key % 10000).cast("string"), 4, "0")))
        .when(key % 7 == 0, "Max retries reached, giving up")
        .when(key % 11 == 0, "PARSING FAILURE in reply")
        .otherwise(F.concat(F.lit("Loaded "), "o_orderpriority"))
    )
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" - INFO - "), text)
    return table(spark, folder, "orders").select("o_orderkey", line.alias("value"))


LOG_SQL = """lines AS (
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' - INFO - ' ||
    CASE WHEN o_orderkey % 3 = 0 THEN 'KNN Fold 1 Accuracy: 0.' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')
         WHEN o_orderkey % 7 = 0 THEN 'Max retries reached, giving up'
         WHEN o_orderkey % 11 = 0 THEN 'PARSING FAILURE in reply'
         ELSE 'Loaded ' || o_orderpriority END AS value
  FROM orders)"""


def written_log(spark, folder):
    path = new_folder(spark, "log")
    # a range sort, so that the part files follow the keys
    log_lines(spark, folder).orderBy("o_orderkey").select("value").write.text(path)
    return path


def scan_log_text(spark, folder):
    return scan_numbered_lines(spark, written_log(spark, folder))


def sink_results(spark, folder):
    path = new_folder(spark, "results")
    orders = table(spark, folder, "orders")
    for method, fresh in (("LR", True), ("KNN", False)):
        rows = orders.groupBy(F.col("o_orderpriority").alias("dataset")).agg(
            F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy")
        )
        rows = rows.withColumn("method", F.lit(method)).withColumn("fold", F.lit(1))
        rows = rows.withColumn("hyperparameters", F.lit('{"a": 1, "b": 2}'))
        results.sink_results(rows, path, fresh=fresh)
    return results.scan_results(spark, path).select(
        "dataset", F.col("fold").cast("bigint").alias("fold"), "method", r6("accuracy").alias("accuracy"), "hyperparameters"
    )


def dataset_catalog(spark, folder):
    root = new_folder(spark, "datasets")
    customer = table(spark, folder, "customer")
    for segment in categories(customer, ["c_mktsegment"])["c_mktsegment"]:
        rows = customer.filter(F.col("c_mktsegment") == segment).select("c_custkey", "c_nationkey", "c_acctbal")
        if len(segment) > 8:
            sidecar.prepare_dataset(rows, root, segment, target=0, order="c_custkey")
        else:
            delimited.sink_csv_positional(rows, f"{root}/{segment}/{segment}.csv")
    return sidecar.dataset_catalog(spark, root)


def vector_table(spark, folder):
    data = vectors(spark, folder)
    stored = build_vector_table(data, hash_embedder, new_folder(spark, "vectors"))
    return stored.select("id", "document", F.size("embedding").alias("dimension"))


QUERIES = {
    "scan_csv_positional": scan_csv_positional,
    "scan_csv_header": scan_csv_header,
    "scan_arff": scan_arff,
    "convert_arff_csv": convert_arff_csv,
    "scan_metadata": scan_metadata,
    "build_metadata": build_metadata,
    "sink_csv_positional": sink_csv_positional,
    "scan_event_jsonl": scan_event_jsonl,
    "scan_log_text": scan_log_text,
    "sink_results": sink_results,
    "build_vector_table": vector_table,
    "dataset_catalog": dataset_catalog,
}

_ARFF_SQL = """SELECT p_partkey::{key} AS p_partkey, p_type, p_brand,
  CASE WHEN p_size <> 10 THEN p_size END::DOUBLE AS p_size, p_retailprice FROM part"""
_METADATA_SQL = """SELECT 2::BIGINT AS target_column_index, 5::BIGINT AS num_features, n AS num_samples, i AS feature_index
FROM (SELECT count(*) AS n FROM orders), range(6) t(i) WHERE i <> 2"""

ORACLES = {
    "scan_csv_positional": """SELECT o_orderkey AS c0, o_custkey AS c1,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS c2 FROM orders""",
    "scan_csv_header": """SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment
        FROM customer""",
    "scan_arff": _ARFF_SQL.format(key="DOUBLE"),
    "convert_arff_csv": _ARFF_SQL.format(key="DOUBLE"),
    "scan_metadata": _METADATA_SQL,
    "build_metadata": _METADATA_SQL,
    "sink_csv_positional": "SELECT o_orderkey AS c0, o_orderpriority AS c1, o_totalprice AS c2 FROM orders",
    "scan_event_jsonl": f"WITH {EVENTS_SQL} SELECT * FROM read",
    "scan_log_text": f"""WITH {LOG_SQL}
        SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, value FROM lines""",
    "sink_results": """SELECT o_orderpriority AS dataset, 1::BIGINT AS fold, method,
        round(avg((o_orderstatus = 'F')::INTEGER), 6) AS accuracy, '{"a": 1, "b": 2}' AS hyperparameters
        FROM orders, (VALUES ('LR'), ('KNN')) m(method) GROUP BY o_orderpriority, method""",
    "dataset_catalog": """SELECT c_mktsegment AS dataset, true AS has_csv,
        length(c_mktsegment) > 8 AS has_metadata, length(c_mktsegment) > 8 AS complete
        FROM customer GROUP BY c_mktsegment""",
}
