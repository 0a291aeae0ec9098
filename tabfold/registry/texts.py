"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabfold.functions import labels as LB
from tabfold.functions import numbers as N
from tabfold.functions import text as X
from tabfold.registry.base import STATUS_CODE_SQL, r6, status_code, table


def row_to_text(spark, folder):
    orders = table(spark, folder, "orders").withColumn("label", status_code())
    columns = ["o_custkey", "o_totalprice"]
    return orders.select(
        "o_orderkey",
        X.row_text(orders, columns, "label").alias("document"),
        X.row_text(orders, columns).alias("query"),
    )


def row_to_json(spark, folder):
    orders = table(spark, folder, "orders").withColumn(
        "price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    )
    text = X.row_json(["o_custkey", "price", "o_orderstatus"])
    back = F.from_json("j", "o_custkey bigint, price double, o_orderstatus string")
    read = orders.select("o_orderkey", text.alias("j")).select(
        "o_orderkey", F.size(F.json_object_keys("j")).cast("bigint").alias("n_keys"), back.alias("r")
    )
    return read.select("o_orderkey", "n_keys", "r.*")


def replies(spark, folder):
    """Model replies of eight shapes, good and bad, from the orders."""
    code, key = status_code().cast("string"), F.col("o_orderkey") % 8

    def answer(value, rest=', "reasoning": "r"}'):
        return F.concat(F.lit('{"classification": '), value, F.lit(rest))

    text = (
        F.when(key == 0, answer(code))
        .when(key == 1, F.concat(F.lit("Sure:\n```json\n"), answer(code), F.lit("\n```")))
        .when(key == 2, answer(F.concat(F.lit('"'), code, F.lit('"'))))
        .when(key == 3, answer(F.concat(code, F.lit(".5"))))
        .when(key == 4, answer(code, "}"))
        .when(key == 5, answer(code, ', "reasoning": {"a": "b"}}'))
        .when(key == 6, F.concat(F.lit("  no json for "), "o_orderpriority", F.lit(" ")))
        .otherwise(answer(F.col("o_custkey").cast("string")))
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("reply"))


REPLIES_SQL = f"""replies AS (
  SELECT o_orderkey, CASE o_orderkey % 8
    WHEN 0 THEN '{{"classification": ' || c || ', "reasoning": "r"}}'
    WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"classification": ' || c || ', "reasoning": "r"}}' || chr(10) || '```'
    WHEN 2 THEN '{{"classification": "' || c || '", "reasoning": "r"}}'
    WHEN 3 THEN '{{"classification": ' || c || '.5, "reasoning": "r"}}'
    WHEN 4 THEN '{{"classification": ' || c || '}}'
    WHEN 5 THEN '{{"classification": ' || c || ', "reasoning": {{"a": "b"}}}}'
    WHEN 6 THEN '  no json for ' || o_orderpriority || ' '
    ELSE '{{"classification": ' || o_custkey || ', "reasoning": "r"}}' END AS reply
  FROM (SELECT *, {STATUS_CODE_SQL} AS c FROM orders)),
blocks AS (SELECT o_orderkey, reply, regexp_extract(reply, '\\{{[^}}]*\\}}') AS block FROM replies),
parsed AS (
  SELECT o_orderkey, CASE WHEN json_type(j, '$.reasoning') = 'VARCHAR'
    AND regexp_matches(json_extract_string(j, '$.classification'), '^[+-]?[0-9]+$')
    THEN json_extract_string(j, '$.classification')::INTEGER END AS answer
  FROM (SELECT o_orderkey, try_cast(nullif(block, '') AS JSON) AS j FROM blocks))"""


def extract_first_json(spark, folder):
    return replies(spark, folder).select("o_orderkey", X.extract_first_json(F.col("reply")).alias("block"))


def parse_answer(spark, folder):
    return X.parse_answer(replies(spark, folder), "reply").select("o_orderkey", F.col("pred").cast("bigint").alias("pred"))


def parse_answer_checked(spark, folder):
    labels = F.array(*[F.lit(i) for i in range(3)])
    parsed = X.parse_answer(replies(spark, folder), "reply", labels=labels)
    return parsed.select("o_orderkey", F.col("pred").cast("bigint").alias("pred"))


def extract_all_json(spark, folder):
    text = F.concat(
        F.lit('Plan {"a": {"b": '), "o_custkey", F.lit("}} then } and "),
        F.when(F.col("o_orderkey") % 3 == 0, '{"c": 1}').otherwise("nothing"),
        F.lit(" tail {open "), "o_orderpriority",
    )
    blocks = table(spark, folder, "orders").select("o_orderkey", X.extract_all_json(text).alias("blocks"))
    found = blocks.select("o_orderkey", F.posexplode_outer("blocks").alias("place", "block"))
    return found.filter("place is not null").withColumn("place", F.col("place").cast("bigint"))


def clamp_int(spark, folder):
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("many"))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
        .otherwise(F.col("o_custkey").cast("string"))
    )
    return table(spark, folder, "orders").select("o_orderkey", N.clamp_int(text, 50, 1000, 600).cast("bigint").alias("v"))


def clamp_float(spark, folder):
    text = (
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("high"))
        .when(F.col("o_orderkey") % 5 == 1, F.lit("nan"))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    value = N.clamp_float(text, 1000.0, 250000.0, 1.5)
    return table(spark, folder, "orders").select("o_orderkey", F.coalesce(F.nanvl(value, F.lit(-1.0)), F.lit(-2.0)).alias("v"))


def none_text(spark, folder):
    word = F.when(F.col("o_orderkey") % 3 == 0, " None ").when(F.col("o_orderkey") % 3 == 1, "NULL").otherwise(
        F.col("o_orderpriority")
    )
    return table(spark, folder, "orders").select("o_orderkey", N.none_text(word).alias("v"))


def selection_summary(spark, folder):
    hp = F.concat(F.lit('{"C":'), "o_custkey", F.lit("}"))
    text = X.selection_summary(F.lower("o_orderstatus"), hp, F.lit('[["lr",0.5]]'))
    return table(spark, folder, "orders").select("o_orderkey", text.alias("summary")).select(
        "*", X.summary_model(F.col("summary")).alias("model"), X.summary_hp(F.col("summary")).alias("hp")
    )


def truncate_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.truncate_text(F.col("text"), 400, "…").alias("shown"), X.truncate_text(F.col("text"), 64).alias("why")
    )


def label_encode(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 12 - 1).alias("label"))
    codes = LB.label_codes(orders, "label")
    encoded = LB.encode_labels(orders, "label", codes)
    return LB.decode_labels(encoded, "code", codes, "decoded").select(
        "o_orderkey", F.col("code").cast("bigint").alias("code"), "decoded"
    )


def _label_array(values):
    return F.array(*[F.lit(v) for v in values])


def align_probabilities(spark, folder):
    share = (F.col("o_custkey") % 11) / 10.0
    aligned = N.align_probabilities(
        F.array(1 - share, share), _label_array([2, 0]), _label_array([0, 1, 2])
    )
    rows = table(spark, folder, "orders").select("o_orderkey", F.posexplode(aligned).alias("place", "p"))
    return rows.select("o_orderkey", F.col("place").cast("bigint").alias("place"), r6("p").alias("p"))


def argmax_label(spark, folder):
    scores = F.array(*[(F.col("o_custkey") % m).cast("double") for m in (3, 5, 4)])
    label = N.argmax_label(scores, _label_array([10, 20, 30]))
    return table(spark, folder, "orders").select("o_orderkey", label.cast("bigint").alias("pred"))


QUERIES = {
    "row_to_text": row_to_text,
    "row_to_json": row_to_json,
    "extract_first_json": extract_first_json,
    "parse_answer": parse_answer,
    "parse_answer_checked": parse_answer_checked,
    "extract_all_json": extract_all_json,
    "clamp_int": clamp_int,
    "clamp_float": clamp_float,
    "none_text": none_text,
    "selection_summary": selection_summary,
    "truncate_text": truncate_text,
    "label_encode": label_encode,
    "align_probabilities": align_probabilities,
    "argmax_label": argmax_label,
}

ORACLES = {
    "row_to_text": f"""SELECT o_orderkey,
        'Features: ' || o_custkey || ', ' || o_totalprice || '. Label: ' || {STATUS_CODE_SQL} AS document,
        'Features: ' || o_custkey || ', ' || o_totalprice AS query FROM orders""",
    "row_to_json": """SELECT o_orderkey, 3::BIGINT AS n_keys, o_custkey,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price, o_orderstatus FROM orders""",
    "extract_first_json": f"""WITH {REPLIES_SQL} SELECT o_orderkey,
        CASE WHEN block <> '' THEN block ELSE trim(reply) END AS block FROM blocks""",
    "parse_answer": f"WITH {REPLIES_SQL} SELECT o_orderkey, coalesce(answer, -1)::BIGINT AS pred FROM parsed",
    "parse_answer_checked": f"""WITH {REPLIES_SQL} SELECT o_orderkey,
        CASE WHEN answer IN (0, 1, 2) THEN answer ELSE -1 END::BIGINT AS pred FROM parsed""",
    "extract_all_json": """WITH texts AS (
          SELECT o_orderkey, 'Plan {"a": {"b": ' || o_custkey || '}} then } and ' ||
            CASE WHEN o_orderkey % 3 = 0 THEN '{"c": 1}' ELSE 'nothing' END || ' tail {open ' || o_orderpriority AS t
          FROM orders),
        chars AS (SELECT o_orderkey, t, unnest(range(1, length(t) + 1)) AS i FROM texts),
        sums AS (SELECT *, sum(CASE t[i] WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END)
                   OVER (PARTITION BY o_orderkey ORDER BY i) AS s FROM chars),
        depths AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY o_orderkey ORDER BY i)) AS d FROM sums),
        steps AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY o_orderkey ORDER BY i), 0) AS before FROM depths),
        starts AS (SELECT o_orderkey, t, i AS a, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS n
                   FROM steps WHERE before = 0 AND d = 1),
        ends AS (SELECT o_orderkey, i AS b, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS n
                 FROM steps WHERE before = 1 AND d = 0)
        SELECT o_orderkey, n - 1 AS place, substring(t, a, b - a + 1) AS block
        FROM starts JOIN ends USING (o_orderkey, n)""",
    "clamp_int": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 AND o_custkey BETWEEN 50 AND 1000
        THEN o_custkey ELSE 600 END AS v FROM orders""",
    "clamp_float": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1.5 WHEN o_orderkey % 5 = 1 THEN -1.0
        WHEN o_totalprice BETWEEN 1000 AND 250000 THEN o_totalprice ELSE 1.5 END::DOUBLE AS v FROM orders""",
    "none_text": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS v FROM orders""",
    "selection_summary": """SELECT o_orderkey,
        'model=' || lower(o_orderstatus) || ', hp={"C":' || o_custkey || '} | leaderboard=[["lr",0.5]]' AS summary,
        lower(o_orderstatus) AS model, '{"C":' || o_custkey || '}' AS hp FROM orders""",
    "truncate_text": """SELECT doc_id, CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '…' ELSE text END AS shown,
        substring(text, 1, 64) AS why FROM documents""",
    "label_encode": """WITH l AS (SELECT o_orderkey, o_custkey % 12 - 1 AS label FROM orders)
        SELECT o_orderkey, dense_rank() OVER (ORDER BY label) - 1 AS code, label AS decoded FROM l""",
    "align_probabilities": """WITH p AS (SELECT o_orderkey, (o_custkey % 11) / 10.0::DOUBLE AS s FROM orders),
        c AS (SELECT o_orderkey, 0 AS place, greatest(s, 1e-12) AS x FROM p
              UNION ALL SELECT o_orderkey, 1, 1e-12 FROM p
              UNION ALL SELECT o_orderkey, 2, greatest(1 - s, 1e-12) FROM p)
        SELECT o_orderkey, place::BIGINT AS place, round(x / sum(x) OVER (PARTITION BY o_orderkey), 6) AS p FROM c""",
    "argmax_label": """SELECT o_orderkey, CASE
        WHEN o_custkey % 3 >= greatest(o_custkey % 5, o_custkey % 4) THEN 10
        WHEN o_custkey % 5 >= o_custkey % 4 THEN 20 ELSE 30 END::BIGINT AS pred FROM orders""",
}
