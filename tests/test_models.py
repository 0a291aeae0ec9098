import numpy as np
import pytest
from pyspark.sql import functions as F

from tabfold.models import estimators as M
from tabfold.models.calibration import calibrate
from tabfold.operators.evaluation import fold_accuracy
from tabfold.plans import benchmark as B
from tabfold.plans import prompting as P
from tabfold.plans.selection import evaluate_candidates, meta_select_predict
from tabfold.registry.prompted import hash_embedder, stub_complete, stub_proposal
from tabfold.sources.sidecar import prepare_dataset

SCHEMA = "row_id bigint, label int, features array<double>"


def _blobs(spark, n=240, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        c = i % classes
        x = rng.normal(size=3) * 0.5
        x[c % 3] += 3.0
        rows.append((i, 10 * (c + 1), [float(v) for v in x]))
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def three(spark):
    data = _blobs(spark)
    return data.filter("row_id % 4 > 0"), data.filter("row_id % 4 = 0")


@pytest.fixture(scope="module")
def two(spark):
    data = _blobs(spark, classes=2)
    return data.filter("row_id % 3 > 0"), data.filter("row_id % 3 = 0")


FITS = {
    "logistic": lambda t: M.fit_logistic(t),
    "balanced": lambda t: M.fit_logistic(t, class_weight="balanced", C=0.5),
    "forest": lambda t: M.fit_random_forest(t, n_estimators=8, max_depth=5),
    "boosted": lambda t: M.fit_boosted_trees(t, max_iter=4, max_depth=3),
    "neighbours": lambda t: M.fit_neighbors(t, n_neighbors=5),
    "neighbours uniform": lambda t: M.fit_neighbors(t, n_neighbors=5, weights="uniform"),
}


def _check(scored, labels):
    rows = scored.collect()
    for r in rows:
        assert abs(sum(r["probabilities"]) - 1) < 1e-6
        assert r["pred"] == labels[int(np.argmax(r["probabilities"]))]
    return np.mean([r["pred"] == r["label"] for r in rows])


@pytest.mark.parametrize("name", list(FITS))
def test_three_classes(three, name):
    model = FITS[name](three[0])
    assert model.labels == [10, 20, 30]
    assert _check(model.score(three[1]), model.labels) > 0.85


@pytest.mark.parametrize("name", ["logistic", "boosted"])
def test_two_classes(two, name):
    model = FITS[name](two[0])
    assert _check(model.score(two[1]), model.labels) > 0.85


@pytest.mark.parametrize("early", [False, True])
def test_boosting_in_a_task_equals_pyspark(spark, monkeypatch, early):
    """The same rounds, trees and probabilities, whoever grows them."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 400, size=(700, 3)) / 7
    y = ((x[:, 0] > 20) ^ (x[:, 1] > 30) ^ (rng.random(700) < 0.1)).astype(int)
    data = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(700)] * 2, SCHEMA).cache()
    shares = []
    for rows in (M.GROWN_ROWS, 0):
        monkeypatch.setattr(M, "GROWN_ROWS", rows)
        model = M.fit_boosted_trees(data, max_iter=12, learning_rate=0.3, max_depth=4, early_stopping=early)
        assert isinstance(model, M.TreesModel if rows else M.OneVsRestModel)
        shares.append(np.array([r["probabilities"] for r in model.score(data).orderBy("row_id").collect()]))
    assert np.abs(shares[0] - shares[1]).max() < 1e-6


def test_trees_refuse_gaps(spark, two):
    model = M.fit_boosted_trees(two[0], max_iter=3)
    assert isinstance(model, M.TreesModel)
    with pytest.raises(Exception, match="NOT_NULL_ASSERT_VIOLATION"):
        model.score(spark.createDataFrame([(1, 10, [1.0, None, 2.0])], SCHEMA)).collect()


def test_forest_in_a_task_is_as_sure_as_pyspark(spark, three, monkeypatch):
    shares = []
    for rows in (M.GROWN_ROWS, 0):
        monkeypatch.setattr(M, "GROWN_ROWS", rows)
        model = M.fit_random_forest(three[0], n_estimators=60)
        assert isinstance(model, M.TreesModel if rows else M.VectorModel)
        shares.append(np.array([r["probabilities"] for r in model.score(three[1]).orderBy("row_id").collect()]))
    assert np.abs(shares[0] - shares[1]).mean() < 0.05 and (shares[0].argmax(1) == shares[1].argmax(1)).mean() > 0.95


def test_registered_cat_style_makes_all_rounds(spark, monkeypatch):
    from tabfold.registry import models

    made = []
    monkeypatch.setattr(M, "fit_boosted_trees", lambda train, **settings: (made.append(settings), M.ConstantModel([0]))[1])
    assert models.fit_cat_style(spark, "/root/testdata/sf0.001").count() > 0
    assert [s["max_iter"] for s in made] == [600] * 5


def test_penalty_strength(spark):
    """The optimum of the penalized loss has zero gradient."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=200) > 0).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(200)]
    fitted = M.fit_logistic(spark.createDataFrame(rows, SCHEMA), C=0.3).model
    w, b = np.array(fitted.coefficients), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(0.3 * x.T @ (p - y) + w).max() < 1e-2 and abs((p - y).sum()) < 1e-2


@pytest.mark.parametrize("name", ["logistic", "forest", "boosted"])
def test_one_class(spark, name):
    data = spark.createDataFrame([(1, 7, [0.0]), (2, 7, [1.0])], SCHEMA)
    assert [r["pred"] for r in FITS[name](data).score(data).collect()] == [7, 7]


def test_labels_must_be_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_CLASSES", 2)
    with pytest.raises(ValueError, match="more than 2 classes"):
        M.fit_logistic(spark.createDataFrame([(i, i, [0.0]) for i in range(3)], SCHEMA))


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration(two, method):
    model = calibrate(two[0], [10, 20], lambda part: M.fit_logistic(part), 160, method=method, folds=2)
    assert _check(model.score(two[1]), model.labels) > 0.85


def test_calibration_of_three_classes(three):
    model = calibrate(three[0], [10, 20, 30], lambda part: M.fit_logistic(part), 180, folds=2)
    assert model.method == "sigmoid"
    assert _check(model.score(three[1]), model.labels) > 0.85


def test_candidate_scores(spark, three):
    rows = [(0, "lr", '{"C":1.0}', ""), (1, "knn", '{"n_neighbors":3,"weights":"uniform"}', ""), (2, "svm", "{}", "")]
    scores = evaluate_candidates(three[0], spark.createDataFrame(rows, "ord int, model string, hp string, why string"), folds=3)
    got = {r["ord"]: r["score"] for r in scores.collect()}
    assert got[0] > 0.85 and got[1] > 0.85 and got[2] is None


def test_selector(two):
    out = meta_select_predict(two[0], two[1], stub_proposal, folds=2, baselines=False)
    rows = out.collect()
    assert len(rows) == two[1].count() and rows[0]["summary"].startswith("model=lr")
    assert fold_accuracy(out, []).first()["accuracy"] > 0.85


def test_registered_selector_tries_the_baselines(spark, monkeypatch):
    """Every fold tries the proposal and the six baselines and fits one of them."""
    from tabfold.plans import selection
    from tabfold.registry import models

    tried = []

    def scores(data, pool, **settings):
        rows = pool.orderBy("ord").collect()
        tried.append([r["model"] for r in rows])
        scored = [(r["ord"], r["model"], r["hp"], r["why"], 0.5, "", None) for r in rows]
        return spark.createDataFrame(scored, selection._SCORE_TYPE)

    monkeypatch.setattr(selection, "evaluate_candidates", scores)
    monkeypatch.setattr(selection, "calibrate", lambda train, labels, fit, n_rows: M.ConstantModel([0]))
    assert models.meta_select_predict(spark, "/root/testdata/sf0.001").count() > 0
    assert tried == [["lr", "rf", "rf", "hgb", "hgb", "lr", "knn"]] * 5


def test_equal_settings_are_fitted_once(spark, two, monkeypatch):
    from tabfold.plans import selection

    fits = []
    monkeypatch.setattr(selection, "fit_candidate", lambda train, model, hp: (fits.append(hp), M.fit_candidate(train, model, hp))[1])
    rows = [(0, "rf", '{"max_depth":40,"min_samples_split":2,"n_estimators":3}', ""), (1, "rf", '{"max_depth":30,"min_samples_split":9,"n_estimators":3}', "")]
    rows += [(2, "lr", '{"C":"x"}', ""), (3, "svm", "{}", "")]
    scores = evaluate_candidates(two[0], spark.createDataFrame(rows, "ord int, model string, hp string, why string"), folds=2)
    got = {r["ord"]: r for r in scores.collect()}
    assert len([f for f in fits if "n_estimators" in f]) == 2
    assert got[0]["score"] == got[1]["score"] > 0.85 and '"max_depth": 30' in got[0]["used"]
    assert got[2]["score"] is None and got[2]["error"] and got[3]["error"] == "ValueError: unknown model 'svm'"


def test_fits_overlap(spark, two):
    from tabfold.models.overlap import overlapped

    def job(i):
        if i == 2:
            raise ValueError("no")
        return M.fit_logistic(two[0], max_iter=3).labels

    results = overlapped(spark, [(f"job {i}", lambda i=i: job(i)) for i in range(5)], 3)
    assert [r for r, _ in results] == [[10, 20]] * 2 + [None] + [[10, 20]] * 2
    assert [e for _, e in results] == [None, None, "ValueError: no", None, None]


def test_the_short_request_follows_a_useless_reply(two):
    from tabfold.plans.selection import propose

    asked = []

    def complete(texts):  # runs in a task: tells the two requests apart by their text
        return ["sorry" if "__target__" in t else stub_proposal([t])[0] for t in texts]

    found = propose(two[0], complete).collect()
    assert [(r["model"], r["hp"]) for r in found] == [("lr", '{"C":0.5}')] and not asked
    useless = propose(two[0], lambda texts: ["no" for _ in texts], attempts=2).collect()
    assert len(useless) > 2


def test_benchmark_folder(spark, tmp_path, three):
    whole = three[0].unionByName(three[1])
    table = whole.selectExpr("row_id", "label", "features[0] a", "features[1] b", "features[2] c")
    prepare_dataset(table, str(tmp_path), "blobs", target=0, order="row_id")
    methods = ["KNN", "LR", "NSP", "Hybrid_model", "RAG"]
    settings = {m: {"complete": stub_complete} for m in ("NSP", "Hybrid_model")}
    settings["RAG"] = {"complete": stub_complete, "embed": hash_embedder}
    out = B.run_benchmark(spark, str(tmp_path), ["blobs", "missing"], methods, f"{tmp_path}/out", folds=2, settings=settings)
    rows = out.collect()
    assert sorted((r["fold"], r["method"]) for r in rows) == sorted((f, m) for f in (0, 1) for m in methods)
    assert all(r["accuracy"] > 0.85 for r in rows if r["method"] in ("KNN", "LR"))
    assert {r["dataset"] for r in rows} == {"blobs"}


def test_unknown_method(three):
    with pytest.raises(ValueError, match="unknown methods"):
        B.benchmark_table(three[0], "d", ["KNN", "SVM"])


def test_failing_completion_gives_no_answer(three):
    def broken(texts):
        raise RuntimeError("no server")

    answers = P.classify_few_shot(three[0], three[1], broken)
    assert {r["pred"] for r in answers.collect()} == {-1}
    replied = P.score_prompts(P.zero_shot_prompts(three[0], three[1]), broken)
    assert {(r["reply"], r["error"]) for r in replied.select("reply", "error").collect()} == {(None, "RuntimeError: no server")}


def test_one_bad_prompt_loses_one_reply(spark):
    def picky(texts):
        if "p7" in texts:
            raise ValueError("bad prompt")
        return [t + "!" for t in texts]

    asked = spark.range(100).select(F.concat(F.lit("p"), "id").alias("prompt"))
    rows = P.score_prompts(asked, picky, parallelism=3)
    got = {r["prompt"]: (r["reply"], r["error"]) for r in rows.collect()}
    assert got.pop("p7") == (None, "ValueError: bad prompt")
    assert len(got) == 99 and all(v == (k + "!", None) for k, v in got.items())


def test_replies_are_asked_for_once(spark, tmp_path):
    def noting(texts):
        with open(f"{tmp_path}/asked", "a") as file:
            file.write("x" * len(texts))
        return texts

    rows = P.score_prompts(spark.range(50).select(F.col("id").cast("string").alias("prompt")), noting, batch_rows=5)
    assert rows.count() == 50 and rows.where("reply IS NOT NULL").count() == 50
    assert len((tmp_path / "asked").read_text()) == 50


def test_right_answers_arrive(three):
    """A completion that reads the retrieved examples votes like a neighbour search."""

    def nearest(texts):
        import re

        out = []
        for t in texts:
            labels = re.findall(r'"label":(\d+)', t)
            out.append('{"classification": %s, "reasoning": "nearest"}' % labels[0])
        return out

    answers = P.classify_hybrid(three[0], three[1], nearest, k=3)
    scored = answers.join(three[1].select("row_id", "label"), "row_id")
    assert fold_accuracy(scored, []).first()["accuracy"] > 0.85


def _copied(spark, copies):
    """70 different rows, each ``copies`` times, with a rule as label."""
    rows = spark.range(70 * copies).selectExpr("id AS row_id", "cast(id % 10 AS double) a", "cast(id % 7 AS double) b")
    return rows.selectExpr("row_id", "cast(a + b >= 8 AS int) AS label", "array(a, b) AS features")


@pytest.mark.parametrize("name", ["logistic", "balanced", "forest", "boosted"])
def test_fits_see_equal_rows_once(spark, monkeypatch, name):
    """What a fit passes over does not grow with copies, and every copy counts."""
    seen = []
    whole = M.equal_rows

    def counted(rows, *more):
        found = whole(rows, *more)
        seen.append((found.count(), found.agg(F.sum("_weight")).first()[0]))
        return found

    monkeypatch.setattr(M, "equal_rows", counted)
    monkeypatch.setattr(M, "BAG_SLICES", 8)
    data = _copied(spark, 300)
    scored = FITS[name](data).score(data.limit(70)).collect()
    assert np.mean([r["pred"] == r["label"] for r in scored]) > 0.85
    [(rows, weight)] = seen
    assert rows <= 70 * 8 and weight == 21_000


def test_weights_stand_for_copies(spark):
    """The fit of copied rows is that of the same rows in one go, with the penalty that their number calls for."""
    data = _copied(spark, 3).where("row_id % 70 < 35 OR row_id < 70")
    x = np.array([r["features"] for r in data.collect()])
    y = np.array([r["label"] for r in data.collect()])
    fitted = M.fit_logistic(data, C=0.3).model
    w, b = np.array(fitted.coefficients), fitted.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(0.3 * x.T @ (p - y) + w).max() < 2e-2 and abs((p - y).sum()) < 2e-2
