import json

import pytest

from tabfold.operators.evaluation import best_candidate, leaderboard
from tabfold.plans import candidates as C
from tabfold.plans.selection import choose

REPLIES = {
    '{"candidates":[{"model":"rf","hyperparameters":{"n_estimators":80},"why":"w"},{"model":"lr"}]}': ["rf", "lr"],
    'x {"num_samples":1} then {"model":"knn","hyperparameters":{},"reasoning":"r"}': ["knn"],
    '{"candidates":[{"model":"svm"},{"model":"rf"}]}': None,
    '{"candidates":[{"model":"rf","why":3}]}': None,
    '{"candidates":[{"model":"rf","hyperparameters":null}]}': None,
    '{"candidates":[]}': None,
    '{"candidates":[{"no":1}]} {"model":"hgb","hyperparameters":{"a":1}}': ["hgb"],
    '{"a":1} {"model":"lr","hyperparameters":{}} {"model":"rf","hyperparameters":{}}': ["lr"],
    '{"model":"lr","hyperparameters":{"C":1}': None,
    '{"candidates":[{"model":"lr","why":"one } brace"}]}': ["lr"],
    '[{"model":"lr","why":"one } brace"}]': ["lr"],
    "[1, 2]": None,
    "": None,
    None: None,
}


def test_reading_replies(spark):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, reply string")
    got = {r["i"]: r["found"] for r in C.read_candidates(rows, "reply").collect()}
    for i, expected in enumerate(REPLIES.values()):
        models = None if got[i] is None else [c["model"] for c in got[i]]
        assert models == expected, list(REPLIES)[i]


def test_defaults_when_nothing_is_found(spark):
    rows = spark.createDataFrame([(0, "sorry")], "i int, reply string")
    assert [r["model"] for r in C.parse_candidates(rows, "reply", defaults=True).orderBy("ord").collect()] == ["hgb", "rf", "rf", "lr", "knn"]
    assert C.parse_candidates(rows, "reply").count() == 0


SANITIZED = [
    ("rf", {"n_estimators": 10}, {"n_estimators": 600}),
    ("rf", {"n_estimators": 70.9, "max_depth": "None"}, {"n_estimators": 70, "max_depth": None}),
    ("rf", {"max_depth": 0, "min_samples_leaf": "3", "min_samples_split": True}, {"max_depth": None, "min_samples_leaf": 3, "min_samples_split": 2}),
    ("rf", {"max_depth": "12.0", "n_estimators": [1]}, {"max_depth": None, "n_estimators": 600}),
    ("lr", {"C": "2", "class_weight": "balanced"}, {"C": 2.0, "class_weight": "balanced"}),
    ("lr", {"C": 1e9, "class_weight": "None"}, {"C": 1.0, "class_weight": None}),
    ("lr", {"C": True}, {"C": 1.0}),
    ("hgb", {"learning_rate": "high", "max_iter": 60, "zzz": 1}, {"learning_rate": 0.06, "max_iter": 60}),
    ("hgb", {"learning_rate": "nan"}, {"learning_rate": "NaN"}),
    ("knn", {"n_neighbors": 97, "weights": "x"}, {"n_neighbors": 30, "weights": "distance"}),
    ("knn", {"n_neighbors": 5, "weights": "uniform"}, {"n_neighbors": 5, "weights": "uniform"}),
    ("knn", None, {"n_neighbors": 30, "weights": "distance"}),
]


def test_sanitizing(spark):
    rows = [(i, m, None if hp is None else json.dumps(hp), 100) for i, (m, hp, _) in enumerate(SANITIZED)]
    table = spark.createDataFrame(rows, "ord int, model string, hp string, n bigint")
    for r in C.sanitize_candidates(table, "n").collect():
        model, _, expected = SANITIZED[r["ord"]]
        values = json.loads(r["hp"])
        assert list(values) == sorted(C.BOUNDS[model])
        assert {k: values[k] for k in expected} == expected


def test_pool_keeps_the_first_of_equals(spark):
    groups = spark.createDataFrame([("d", 100, 0.9)], "g string, n bigint, p double")
    own = spark.createDataFrame(
        [("d", 0, "rf", '{"n_estimators": 600}', "mine"), ("d", 1, "lr", "{}", "plain"), ("d", 2, "lr", '{"C": 1}', "again")],
        "g string, ord int, model string, hp string, why string",
    )
    pool = C.candidate_pool(own, groups, ["g"], "n", "p").orderBy("ord").collect()
    assert [(r["model"], r["why"]) for r in pool] == [
        ("rf", "mine"), ("lr", "plain"), ("rf", "more trees"), ("hgb", "longer hgb"), ("hgb", "faster hgb"),
        ("lr", "linear check"), ("knn", "scale k"),
    ]
    assert json.loads(pool[-1]["hp"])["n_neighbors"] == 20
    assert json.loads(pool[-2]["hp"])["class_weight"] == "balanced"


SCORES = "ord int, model string, hp string, why string, score double"


def test_choice(spark):
    rows = [(0, "lr", "{}", "", 0.5), (1, "rf", '{"n":1}', "", 0.7), (2, "hgb", "{}", "", 0.7), (3, "knn", "{}", "", float("nan")), (4, "lr", "{}", "", None)]
    scores = spark.createDataFrame(rows, SCORES)
    model, hp, summary = choose(scores)
    assert (model, hp) == ("rf", '{"n":1}')
    assert summary == 'model=rf, hp={"n":1} | leaderboard=[["rf", 0.7], ["hgb", 0.7], ["lr", 0.5]]'
    assert [r["ord"] for r in leaderboard(scores, size=2).orderBy("place").collect()] == [1, 2]


@pytest.mark.parametrize("rows", [[], [(0, "lr", "{}", "", None), (1, "rf", "{}", "", float("nan"))]])
def test_choice_without_any_score(spark, rows):
    scores = spark.createDataFrame(rows, SCORES)
    assert best_candidate(scores).first()["best"] is None
    model, hp, _ = choose(scores)
    assert model == "hgb" and json.loads(hp)["max_iter"] == 600


def test_reasons_are_cut_only_outside_of_named_lists(spark):
    why = "r" * 100
    replies = [
        json.dumps({"candidates": [{"model": "rf", "why": why}]}),
        json.dumps({"model": "rf", "hyperparameters": {}, "reasoning": why}),
        json.dumps([{"model": "rf", "why": "one } brace " + why}]),
    ]
    rows = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = {r["i"]: len(r["why"]) for r in C.parse_candidates(rows, "reply").collect()}
    assert got == {0: 100, 1: 64, 2: 64}
