"""Profiles, counts, logs, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.operators import evaluation as E
from tabfold.operators import log_summary as L
from tabfold.operators import profiling as P
from tabfold.registry.base import STATUS_CODE_SQL, r6, status_code, table
from tabfold.registry.tables import EVENTS_SQL, LOG_SQL, event_lines, log_lines, written_log
from tabfold.sources.lines import scan_numbered_lines
from tabfold.sources.logs import parse_events, scan_event_jsonl, scan_log_text
from tabfold.workspace import new_folder


def label_space(spark, folder):
    labels = P.label_space(table(spark, folder, "orders"), "o_orderpriority")
    return labels.select(F.posexplode("labels").alias("place", "label")).withColumn("place", F.col("place").cast("bigint"))


def class_priors(spark, folder):
    return P.class_priors(table(spark, folder, "orders"), "o_orderpriority").select("label", "n", r6("prior").alias("prior"))


def _gappy(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        status_code().alias("label"),
    )


_GAPPY_SQL = f"""gappy AS (
  SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, {STATUS_CODE_SQL} AS label FROM orders)"""
_FEATURES = ["o_custkey", "status", "price"]
_PROFILE_SQL = """profile AS (
  SELECT 0 AS idx, 'o_custkey' AS name, 'int64' AS dtype, count(DISTINCT o_custkey) AS n_unique,
         round(avg((o_custkey IS NULL)::INTEGER), 6) AS missing_pct FROM gappy
  UNION ALL SELECT 1, 'status', 'object', count(DISTINCT status), round(avg((status IS NULL)::INTEGER), 6) FROM gappy
  UNION ALL SELECT 2, 'price', 'float64', count(DISTINCT price), round(avg((price IS NULL)::INTEGER), 6) FROM gappy)"""


def max_class_prior(spark, folder):
    return P.max_class_prior(_gappy(spark, folder), "status").select(r6("max_prior").alias("max_prior"))


def column_profile(spark, folder):
    profile = P.column_profile(_gappy(spark, folder), _FEATURES)
    return profile.withColumn("idx", F.col("idx").cast("bigint"))


def schema_card(spark, folder):
    card = P.schema_card(_gappy(spark, folder), "label", _FEATURES)
    c = card.select(F.from_json("card", P.CARD_TYPE).alias("c")).select("c.*")
    priors = c.select(
        F.lit("prior").alias("part"), F.explode("class_priors").alias("k", "x")
    ).select("part", F.col("k").alias("name"), r6("x").alias("x"))
    shape = c.select(
        F.explode(
            F.array(
                F.struct(F.lit("shape").alias("part"), F.lit("rows").alias("name"), F.col("n_rows").cast("double").alias("x")),
                F.struct(F.lit("shape").alias("part"), F.lit("columns").alias("name"), F.col("n_cols").cast("double").alias("x")),
                F.struct(F.lit("shape").alias("part"), F.lit("labels").alias("name"), F.size("labels").cast("double").alias("x")),
            )
        ).alias("s")
    ).select("s.*")
    columns = c.select(F.explode("columns").alias("c")).select(
        F.lit("column").alias("part"),
        F.concat_ws("/", "c.idx", "c.name", "c.dtype", "c.unique").alias("name"),
        F.col("c.missing_pct").alias("x"),
    )
    return priors.unionByName(shape).unionByName(columns)


def rows_by_class(spark, folder):
    return P.rows_by_class(table(spark, folder, "orders"), "o_orderstatus", "o_orderkey")


def constant_label_predict(spark, folder):
    orders = table(spark, folder, "orders")
    train = orders.select((F.col("o_totalprice") >= 0).cast("int").alias("label"))
    return P.constant_label_predict(train, orders.select("o_orderkey"), "label").select(
        "o_orderkey", F.col("pred").cast("bigint").alias("pred")
    )


def event_counts(spark, folder):
    return L.event_counts(table(spark, folder, "events"), "event_type")


def prediction_outcomes(spark, folder):
    return L.prediction_outcomes(_named_events(parse_events(event_lines(spark, folder))))


def _named_events(events):
    """Event types of the test table under the names of a run log."""
    name = (
        F.when(F.col("event") == "click", "prediction_accuracy")
        .when(F.col("event") == "view", "prompt")
        .when(F.col("event") == "error", "response")
        .otherwise(F.col("event"))
    )
    return events.withColumn("event", name)


_NAMED_SQL = f"""{EVENTS_SQL},
named AS (SELECT CASE event WHEN 'click' THEN 'prediction_accuracy' WHEN 'view' THEN 'prompt'
                 WHEN 'error' THEN 'response' ELSE event END AS event, correct FROM read),
outcomes AS (SELECT count(*) FILTER (event = 'prompt') AS prompts, count(*) FILTER (event = 'response') AS responses,
             count(*) FILTER (event = 'prediction_accuracy' AND correct) AS correct,
             count(*) FILTER (event = 'prediction_accuracy' AND NOT correct) AS incorrect FROM named)"""
_LOG_STATS_SQL = f"""{LOG_SQL},
found AS (SELECT o_orderkey, value,
          try_cast(nullif(regexp_extract(value, 'Accuracy:\\s([0-9.]+)', 1), '') AS DOUBLE) AS accuracy FROM lines),
stats AS (SELECT count(accuracy) AS n_accuracies, avg(accuracy) AS mean_accuracy,
          count(*) FILTER (contains(value, 'Max retries reached') OR contains(lower(value), 'parsing failure'))
            AS parse_failures FROM found)"""


def log_accuracies(spark, folder):
    return L.log_accuracies(scan_numbered_lines(spark, written_log(spark, folder)))


def log_accuracy_stats(spark, folder):
    stats = L.log_accuracy_stats(log_lines(spark, folder))
    return stats.select("n_accuracies", r6("mean_accuracy").alias("mean_accuracy"))


def log_parse_failures(spark, folder):
    return L.log_parse_failures(log_lines(spark, folder))


def log_summary(spark, folder):
    path = new_folder(spark, "events")
    event_lines(spark, folder).write.text(path)
    events = _named_events(scan_event_jsonl(spark, path))
    summary = L.log_summary(events, scan_log_text(spark, written_log(spark, folder)))
    reals = ["mean_accuracy", "failure_rate", "success_rate"]
    return summary.select(*[r6(c).alias(c) if c in reals else F.col(c) for c in summary.columns])


def _scores(spark, folder):
    """A score table with equal scores, a NaN and a gap."""
    groups = table(spark, folder, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.round(F.avg((F.col("o_totalprice") > 250000).cast("double")), 1).alias("share")
    )
    status = F.col("o_orderstatus")
    ord_ = (F.ascii(status) * 10 + F.substring("o_orderpriority", 1, 1).cast("int")).cast("int")
    score = (
        F.when(ord_ % 6 == 0, F.lit(float("nan"))).when(ord_ % 7 == 0, F.lit(None)).otherwise(F.col("share"))
    )
    return groups.select(
        status.alias("g"), ord_.alias("ord"), F.col("o_orderpriority").alias("model"), F.lit("{}").alias("hp"), score.alias("score")
    )


_SCORES_SQL = """scores AS (
  SELECT g, ord, model, CASE WHEN ord % 6 = 0 OR ord % 7 = 0 THEN NULL ELSE share END AS score FROM (
    SELECT o_orderstatus AS g, ascii(o_orderstatus) * 10 + o_orderpriority[1]::INTEGER AS ord,
           o_orderpriority AS model, round(avg((o_totalprice > 250000)::INTEGER), 1) AS share
    FROM orders GROUP BY o_orderstatus, o_orderpriority))"""


def leaderboard(spark, folder):
    board = E.leaderboard(_scores(spark, folder))
    return board.select(F.col("place").cast("bigint").alias("place"), F.col("ord").cast("bigint").alias("ord"), "model", "score")


def best_candidate(spark, folder):
    best = E.best_candidate(_scores(spark, folder), ["g"])
    return best.select("g", F.col("best.ord").cast("bigint").alias("ord"), "best.model", "best.score")


QUERIES = {
    "label_space": label_space,
    "class_priors": class_priors,
    "max_class_prior": max_class_prior,
    "column_profile": column_profile,
    "schema_card": schema_card,
    "rows_by_class": rows_by_class,
    "constant_label_predict": constant_label_predict,
    "event_counts": event_counts,
    "prediction_outcomes": prediction_outcomes,
    "log_accuracies": log_accuracies,
    "log_accuracy_stats": log_accuracy_stats,
    "log_parse_failures": log_parse_failures,
    "log_summary": log_summary,
    "leaderboard": leaderboard,
    "best_candidate": best_candidate,
}

ORACLES = {
    "label_space": """SELECT row_number() OVER (ORDER BY label) - 1 AS place, label
        FROM (SELECT DISTINCT o_orderpriority AS label FROM orders)""",
    "class_priors": """SELECT o_orderpriority AS label, count(*) AS n,
        round(count(*) / (SELECT count(*) FROM orders), 6) AS prior FROM orders GROUP BY o_orderpriority""",
    "max_class_prior": f"""WITH {_GAPPY_SQL}, c AS (SELECT count(*) AS n FROM gappy WHERE status IS NOT NULL GROUP BY status)
        SELECT round(max(n) / sum(n), 6) AS max_prior FROM c""",
    "column_profile": f"WITH {_GAPPY_SQL}, {_PROFILE_SQL} SELECT * REPLACE (idx::BIGINT AS idx) FROM profile",
    "schema_card": f"""WITH {_GAPPY_SQL}, {_PROFILE_SQL}
        SELECT 'prior' AS part, label::VARCHAR AS name, round(count(*) / (SELECT count(*) FROM gappy), 6) AS x
        FROM gappy GROUP BY label
        UNION ALL SELECT 'shape', 'rows', count(*)::DOUBLE FROM gappy
        UNION ALL SELECT 'shape', 'columns', 3.0
        UNION ALL SELECT 'shape', 'labels', count(DISTINCT label)::DOUBLE FROM gappy
        UNION ALL SELECT 'column', concat_ws('/', idx, name, dtype, n_unique), missing_pct FROM profile""",
    "rows_by_class": """SELECT o_orderstatus AS label, o_orderkey AS row_id,
        row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS place FROM orders""",
    "constant_label_predict": """SELECT o_orderkey, (SELECT CASE WHEN min(l) = max(l) THEN min(l) END
        FROM (SELECT (o_totalprice >= 0)::INTEGER AS l FROM orders))::BIGINT AS pred FROM orders""",
    "event_counts": "SELECT event_type AS event, count(*) AS n FROM events GROUP BY event_type",
    "prediction_outcomes": f"WITH {_NAMED_SQL} SELECT * FROM outcomes",
    "log_accuracies": f"""WITH {_LOG_STATS_SQL},
        numbered AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, accuracy FROM found)
        SELECT * FROM numbered WHERE accuracy IS NOT NULL""",
    "log_accuracy_stats": f"""WITH {_LOG_STATS_SQL}
        SELECT n_accuracies, round(mean_accuracy, 6) AS mean_accuracy FROM stats""",
    "log_parse_failures": f"WITH {_LOG_STATS_SQL} SELECT parse_failures FROM stats",
    "log_summary": f"""WITH {_NAMED_SQL}, {_LOG_STATS_SQL}
        SELECT o.*, n_accuracies, round(mean_accuracy, 6) AS mean_accuracy, parse_failures,
          correct + incorrect + parse_failures AS predictions,
          CASE WHEN correct + incorrect + parse_failures > 0
            THEN round(parse_failures * 100.0::DOUBLE / (correct + incorrect + parse_failures), 6) ELSE 0 END AS failure_rate,
          CASE WHEN n_accuracies + parse_failures > 0
            THEN round(n_accuracies * 100.0::DOUBLE / (n_accuracies + parse_failures), 6) ELSE 0 END AS success_rate
        FROM outcomes o, stats""",
    "leaderboard": f"""WITH {_SCORES_SQL}
        SELECT row_number() OVER (ORDER BY score DESC, ord) AS place, ord::BIGINT AS ord, model, score
        FROM scores WHERE score IS NOT NULL ORDER BY score DESC, ord LIMIT 6""",
    "best_candidate": f"""WITH {_SCORES_SQL}, ranked AS (
          SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, ord) AS n FROM scores WHERE score IS NOT NULL)
        SELECT g, ord::BIGINT AS ord, model, score FROM ranked WHERE n = 1""",
}
