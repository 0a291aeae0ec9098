import json
import math

import pytest
from pyspark.sql import functions as F

from tabfold.functions import labels as L
from tabfold.operators import cleaning as C
from tabfold.operators import profiling as P


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, "True", "red", 9.0, 0),
        (2, "False", "blue", None, 1),
        (3, None, None, 11.5, 0),
        (4, "True", "green", 10.0, 1),
    ]
    return spark.createDataFrame(rows, "id int, flag string, color string, score double, label int")


def test_encode_table(mixed):
    got = C.encode_table(mixed, remove=0, target=1, threshold=10)
    assert got.columns == ["flag", "score", "label", "color_green", "color_red"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, 0, 0, 0, 1), (0, 0, 1, 0, 0), (None, 1, 0, 0, 0), (1, 1, 1, 1, 0)], key=str
    )


def test_booleans_with_gaps_are_categories(spark):
    rows = spark.createDataFrame([(1, True, True), (2, None, False), (3, False, True)], "id int, gap boolean, full boolean")
    got = C.encode_table(rows)
    assert got.columns == ["id", "full", "gap_True"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 0, 0), (3, 1, 0)]


def test_all_null_text_column_counts_as_boolean(spark):
    rows = spark.createDataFrame([(1, None)], "id int, t string")
    assert dict(C.bool_text_to_int(rows).dtypes)["t"] == "int"


def test_positions_out_of_range(mixed):
    assert C.drop_by_position(mixed, 9).columns == mixed.columns
    assert C.threshold_binarize(mixed, -1, 1).collect() == mixed.collect()
    with pytest.raises(IndexError):
        C.split_target(mixed, 5)


def test_category_limit(mixed):
    with pytest.raises(ValueError, match="more than 2 categories"):
        C.one_hot_encode(mixed, ["color"], limit=2)


def test_skip_and_head(spark):
    rows = spark.range(50).withColumn("id", F.col("id") * 3)
    assert [r.id for r in C.skip_rows(rows, 48, "id").orderBy("id").collect()] == [144, 147]
    assert C.skip_rows(rows, 0, "id").count() == 50
    with pytest.raises(Exception, match="no more than 50 rows"):
        C.skip_rows(rows, 50, "id").collect()
    with pytest.raises(IndexError):
        C.skip_rows(rows, -1, "id")
    assert [r.id for r in C.head_fraction(rows, 0.07, "id").orderBy("id").collect()] == [0, 3, 6]
    assert C.head_fraction(rows, 1.0, "id").count() == 50


def test_skip_many_rows(spark):
    rows = spark.range(30_000).repartition(7)
    assert sorted(r.id for r in C.skip_rows(rows, 10_001, "id").collect()) == list(range(10_001, 30_000))


def test_skip_by_a_text(spark):
    rows = spark.range(200).select(F.format_string("k%05d", "id").alias("id"))
    for n in (1, 77, 199):
        assert sorted(r.id for r in C.skip_rows(rows, n, "id").collect()) == [f"k{i:05d}" for i in range(n, 200)]


def test_standardize(spark):
    rows = spark.createDataFrame(
        [(0, [1.0, 5.0, None]), (1, [3.0, 5.0, 1.0]), (2, [8.0, 5.0, 3.0])], "id int, features array<double>"
    )
    got = {r.id: r.features for r in C.standardize(rows, rows).collect()}
    columns = list(zip(*[got[i] for i in range(3)]))
    assert abs(sum(columns[0])) < 1e-12 and abs(sum(x * x for x in columns[0]) / 3 - 1) < 1e-12
    assert columns[1] == (0.0, 0.0, 0.0)  # zero spread counts as 1
    assert columns[2] == (None, -1.0, 1.0)  # a gap stays a gap


def test_standardize_folds_equals_fold_by_fold(spark):
    rows = spark.createDataFrame(
        [(i, i % 3, [float(i * i % 17) + 1e9, float(i)]) for i in range(30)], "id int, fold int, features array<double>"
    )
    got = {(r.split, r.id): r.features for r in C.standardize_folds(rows, 3).collect()}
    for split in range(3):
        for r in C.standardize(rows, rows.filter(F.col("fold") != split)).collect():
            # a mean near 1e9 is known to about 1e-7
            assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(got[(split, r.id)], r.features))


def test_nan_becomes_null(spark):
    rows = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in C.nan_to_null(rows).orderBy("x").collect()] == [None, 1.0]


def test_profile_counts_nan_as_missing(spark):
    rows = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (1.0, "b")], "x double, t string")
    got = {r["name"]: (r["dtype"], r["n_unique"], r["missing_pct"]) for r in P.column_profile(rows).collect()}
    assert got == {"x": ("float64", 1, 0.333333), "t": ("object", 2, 0.333333)}


def test_constant_label(spark):
    one = spark.createDataFrame([(4,), (4,)], "label int")
    two = spark.createDataFrame([(4,), (5,)], "label int")
    test = spark.range(2)
    assert [r.pred for r in P.constant_label_predict(one, test, "label").collect()] == [4, 4]
    assert [r.pred for r in P.constant_label_predict(two, test, "label").collect()] == [None, None]


def test_schema_card_wants_integers(mixed):
    with pytest.raises(TypeError):
        P.schema_card(mixed, "color", ["score"])


def test_schema_card_counts_unlabelled_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0), (0, 4.0), (None, 5.0)], "y int, x double")
    card = json.loads(P.schema_card(rows, "y", ["x"]).first()["card"])
    assert card["n_rows"] == 4 and card["class_priors"] == {"0": 0.25, "1": 0.5}
    assert P.label_space(rows, "y").first()["labels"] == [0, 1]


def test_rows_without_label_stay(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",), ("z",)], "label string")
    codes = L.label_codes(rows.where("label <> 'z'"), "label")
    coded = L.encode_labels(rows, "label", codes)
    assert sorted(((r["label"] or "", r["code"]) for r in coded.collect()), key=str) == [("", None), ("a", 0), ("b", 1), ("z", None)]
    assert L.decode_labels(coded, "code", codes, "again").count() == 4


def test_label_codes_follow_values(spark):
    rows = spark.createDataFrame([(10,), (2,), (1,), (2,)], "label int")
    codes = L.label_codes(rows, "label")
    assert {r["label"]: r["code"] for r in codes.collect()} == {1: 0, 2: 1, 10: 2}
    back = L.decode_labels(L.encode_labels(rows, "label", codes), "code", codes, "again").collect()
    assert len(back) == 4 and all(r["label"] == r["again"] for r in back)
