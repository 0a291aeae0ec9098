import json
import math

import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tabfold.functions import numbers as N
from tabfold.functions import text as X

# every example is a Spark job, so failures are shown as found
QUICK = settings(
    max_examples=3,
    deadline=None,
    phases=[Phase.explicit, Phase.reuse, Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)

CASES = [
    ('{"classification": 1, "reasoning": "r"}', 1, 1),
    ('Sure:\n```json\n{"classification": 1, "reasoning": "r"}\n```', 1, 1),
    ('{\n"classification": 1,\n"reasoning": "r"\n}', 1, 1),
    ('{"classification": 9, "reasoning": "r"}', 9, -1),
    ('{"classification": 1}', -1, -1),
    ('{"classification": "1", "reasoning": "r"}', 1, 1),
    ('{"classification": 1.0, "reasoning": "r"}', 1, 1),
    ('{"classification": true, "reasoning": "r"}', 1, 1),
    ('{"classification": "true", "reasoning": "r"}', -1, -1),
    ('{"classification": 1.5, "reasoning": "r"}', -1, -1),
    ('{"classification": null, "reasoning": "r"}', -1, -1),
    ('{"classification": 1, "reasoning": 5}', -1, -1),
    ('{"classification": 1, "reasoning": {"a": "b"}}', -1, -1),
    ('{"classification": 1, "reasoning": "r"', -1, -1),
    ("no json", -1, -1),
    ("", -1, -1),
    (None, -1, -1),
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, reply string")
    labels = F.array(F.lit(0), F.lit(1), F.lit(2))
    free = X.parse_answer(rows, "reply")
    both = X.parse_answer(free, "reply", labels=labels, name="checked").orderBy("i").collect()
    assert [(r["pred"], r["checked"]) for r in both] == [(c[1], c[2]) for c in CASES]


def _blocks(text):
    out, depth, begin = [], 0, -1
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                begin = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[begin : i + 1])
    return out


@QUICK
@given(st.lists(st.text(alphabet='{}ab"é😀\n', max_size=40), min_size=30, max_size=60))
def test_all_json_blocks(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("t", X.extract_all_json(F.col("t")).alias("b"), X.extract_first_json(F.col("t")).alias("f")).collect()
    for r in got:
        assert r["b"] == _blocks(r["t"])
        at = r["t"].find("{")
        end = r["t"].find("}", at) if at >= 0 else -1
        assert r["f"] == (r["t"][at : end + 1] if end > 0 else r["t"].strip())


def test_long_text_stays_linear(spark):
    text = "{" + "x" * 200_000 + "}" + "{}" * 2_000 + "{" * 5_000
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(F.size(X.extract_all_json(F.col("t")))).first()[0] == 2_001


def _number_texts(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    return [(r["v"], r["t"]) for r in rows.select("v", X.number_text(F.col("v"), T.DoubleType()).alias("t")).collect()]


@QUICK
@given(st.lists(st.integers(-(10**12), 10**12), min_size=100, max_size=200))
def test_number_text_is_that_of_python(spark, thousandths):
    special = [1e7, 1e16, 1e15, 123456789.125, 1e-4, 9.9e-5, 1e22, -2.5e-7, -0.0, math.inf, -math.inf, math.nan]
    for value, text in _number_texts(spark, [t / 1000 for t in thousandths] + special):
        assert text == repr(value)


@QUICK
@given(st.lists(st.floats(allow_nan=False), min_size=100, max_size=200))
def test_number_text_loses_nothing(spark, values):
    # the JVM may print more digits than needed, but they read back as the same number
    assert all(float(text) == value for value, text in _number_texts(spark, values + [5e-324]))


def test_row_texts(spark):
    rows = spark.createDataFrame([(1, 2.5, None, 3)], "a int, b double, c double, y int")
    text = X.row_text(rows, ["a", "b", "c"], "y")
    assert rows.select(text).first()[0] == "Features: 1, 2.5, nan. Label: 3"
    plain, floats = rows.select(X.row_json(["a", "c"]), X.row_json(["a", "b"], F.col("y").alias("label"), as_floats=True)).first()
    assert plain == '{"a":1,"c":null}' and floats == '{"a":1.0,"b":2.5,"label":3}'
    array = spark.createDataFrame([([1.0, None, float("nan")], 4)], "f array<double>, y int")
    assert json.loads(array.select(X.features_json("f", label=F.col("y"))).first()[0]) == {"0": 1.0, "1": None, "2": None, "label": 4}


def test_clamps(spark):
    rows = spark.createDataFrame([(t,) for t in ["7", "0", "99", " 8 ", "7.5", "x", None, "nan", "1" * 60]], "t string")
    whole = [r[0] for r in rows.select(N.clamp_int(F.col("t"), 1, 50, 5)).collect()]
    assert whole == [7, 5, 5, 8, 5, 5, 5, 5, 5]
    real = [r[0] for r in rows.select(N.clamp_float(F.col("t"), 1.0, 50.0, 5.0)).collect()]
    assert real[:7] == [7.0, 5.0, 5.0, 8.0, 7.5, 5.0, 5.0] and math.isnan(real[7]) and real[8] == 5.0


@QUICK
@given(st.lists(st.lists(st.floats(0, 1), min_size=2, max_size=2), min_size=20, max_size=40))
def test_aligned_probabilities_sum_to_one(spark, pairs):
    rows = spark.createDataFrame([(p,) for p in pairs], "p array<double>")
    labels = F.array(*[F.lit(i) for i in (0, 1, 2)])
    classes = F.array(F.lit(2), F.lit(0))
    for r in rows.select("p", N.align_probabilities(F.col("p"), classes, labels).alias("q")).collect():
        assert abs(sum(r["q"]) - 1) < 1e-9 and all(x > 0 for x in r["q"])
        if r["p"][0] > 1e-6:
            assert math.isclose(r["q"][0] / r["q"][2], max(r["p"][1], 1e-12) / r["p"][0], rel_tol=1e-9)


def test_summary_round_trip(spark):
    text = X.selection_summary(F.lit("hgb"), F.lit('{"a":1,"b":null}'), F.lit('[["hgb",0.5]]'))
    row = spark.range(1).select(text.alias("s")).select("s", X.summary_model(F.col("s")), X.summary_hp(F.col("s"))).first()
    assert row[0] == 'model=hgb, hp={"a":1,"b":null} | leaderboard=[["hgb",0.5]]'
    assert tuple(row[1:]) == ("hgb", '{"a":1,"b":null}')


@pytest.mark.parametrize("text,shown", [("abc", "abc"), ("abcdef", "abcd…"), ("abcd", "abcd")])
def test_truncation(spark, text, shown):
    assert spark.range(1).select(X.truncate_text(F.lit(text), 4, "…")).first()[0] == shown
