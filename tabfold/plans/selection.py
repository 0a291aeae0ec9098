"""Choosing a model: cross-validated candidates, the best one fitted, calibrated and applied."""

from __future__ import annotations

import json
import logging
from functools import partial

from pyspark.sql import DataFrame, functions as F, types as T

from tabfold.functions.text import row_json, selection_summary
from tabfold.models.calibration import calibrate
from tabfold.models.estimators import class_sizes, fit_candidate, used_settings
from tabfold.models.overlap import OPEN_FITS, overlapped
from tabfold.operators.cleaning import standardize
from tabfold.operators.evaluation import best_candidate, fold_accuracy, leaderboard
from tabfold.operators.neighbors import k_nearest, vote_distance, vote_uniform
from tabfold.operators.profiling import schema_card
from tabfold.operators.sampling import stratified_cap, stratified_kfold, test_rows, train_rows
from tabfold.plans.candidates import (
    FALLBACK,
    candidate_pool,
    parse_candidates,
    prompt_candidates,
    prompt_candidates_minimal,
    sanitize_candidates,
)
from tabfold.plans.prompting import Complete, score_prompts
from tabfold.workspace import stage

log = logging.getLogger(__name__)

CV_FOLDS = 5
#: Requests for candidates before the defaults are taken.
ATTEMPTS = 5
CV_MAX_ROWS = 50_000
MAX_CANDIDATES = 1000

_SCORE_TYPE = "ord int, model string, hp string, why string, score double, used string, error string"


def neighbor_cv_scores(folded: DataFrame, settings: list[tuple[int, int, str]], chunk_rows: int | None = None) -> DataFrame:
    """Mean fold accuracy of several neighbour candidates (``ord, k, weights``) from one search.

    The search with the largest k contains all others, and covers every fold at once.
    """
    sizes = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    found = stage(
        k_nearest(
            folded, folded, max(k for _, k, _ in settings), test_id="row_id", train_id="row_id",
            payload="label", group="fold", **sizes,
        ),
        "neighbours",
    )
    truth = folded.select("row_id", "label", "fold")
    scores = None
    for place, k, weights in settings:
        near = found.filter(F.col("rank") <= k)
        votes = vote_distance(near) if weights == "distance" else vote_uniform(near)
        scored = votes.withColumnRenamed("test_id", "row_id").join(truth, "row_id")
        mean = fold_accuracy(scored, ["fold"]).agg(F.avg("accuracy").alias("score"))
        mean = mean.select(F.lit(place).alias("ord"), "score")
        scores = mean if scores is None else scores.unionByName(mean)
    return scores


def _neighbour_settings(c) -> tuple[int, int, str]:
    hp = json.loads(c["hp"])
    return c["ord"], hp["n_neighbors"], hp["weights"]


def evaluate_candidates(
    data: DataFrame,
    candidates: DataFrame,
    *,
    folds: int = CV_FOLDS,
    max_rows: int = CV_MAX_ROWS,
    open_fits: int = OPEN_FITS,
) -> DataFrame:
    """``ord, model, hp, why, score, used, error``: mean accuracy over stratified folds; null where a fit failed.

    ``used`` are the settings that a fit looks at, with the depth it really has.  Candidates of equal ``used`` are one fit and
    share its score.  ``open_fits`` fits of candidates and folds run beside one another, over one cached frame of folds.
    """
    spark = data.sparkSession
    folded = stage(
        stratified_kfold(stratified_cap(data, "label", "row_id", max_rows), "label", "row_id", folds),
        "cv-folds",
    )
    todo = candidates.orderBy("ord").limit(MAX_CANDIDATES + 1).collect()
    if len(todo) > MAX_CANDIDATES:
        raise ValueError(f"more than {MAX_CANDIDATES} candidates")
    used: dict[int, str | None] = {}
    errors: dict[int, str] = {}
    for c in todo:
        try:
            used[c["ord"]] = used_settings(c["model"], c["hp"])
        except Exception as error:
            used[c["ord"]], errors[c["ord"]] = None, f"{type(error).__name__}: {error}"
    first = {}  # one candidate speaks for all with the settings it uses
    for c in todo:
        if used[c["ord"]] is not None:
            first.setdefault((c["model"], used[c["ord"]]), c)
    scores: dict[tuple, float] = {}
    failed: dict[tuple, str] = {}
    near = {key: c for key, c in first.items() if key[0] == "knn"}
    if near:
        try:
            found = {r["ord"]: r["score"] for r in neighbor_cv_scores(folded, [_neighbour_settings(c) for c in near.values()]).collect()}
            scores.update({key: found[c["ord"]] for key, c in near.items()})
        except Exception as error:
            failed.update({key: f"{type(error).__name__}: {error}" for key in near})
    fits = [(key, fold) for key in first if key not in near for fold in range(folds)]

    def accuracy(key: tuple, fold: int) -> float:
        model = fit_candidate(train_rows(folded, fold), key[0], first[key]["hp"])
        return fold_accuracy(model.score(test_rows(folded, fold)), []).first()["accuracy"]

    folded.persist()
    try:
        jobs = [(f"{key[0]} {first[key]['ord']} fold {fold}", partial(accuracy, key, fold)) for key, fold in fits]
        results = overlapped(spark, jobs, open_fits)
    finally:
        folded.unpersist()
    by_key: dict[tuple, list[float]] = {}
    for (key, _), (value, error) in zip(fits, results):
        if error is not None:
            failed.setdefault(key, error)
            log.warning("candidate %s %s failed: %s", *key, error)
        else:
            by_key.setdefault(key, []).append(value)
    scores.update({key: sum(v) / folds for key, v in by_key.items() if key not in failed})
    rows = []
    for c in todo:
        key = (c["model"], used[c["ord"]])
        rows.append((c["ord"], c["model"], c["hp"], c["why"], scores.get(key), used[c["ord"]], errors.get(c["ord"]) or failed.get(key)))
    return spark.createDataFrame(rows, _SCORE_TYPE)


def choose(scores: DataFrame) -> tuple[str, str, str]:
    """Model, hyperparameters and one-line summary of the winner."""
    spark = scores.sparkSession
    best = best_candidate(scores).first()["best"]
    if best is None:
        fallback = spark.createDataFrame([(*FALLBACK, 1)], "model string, hp string, n_rows bigint")
        model, hp, _ = sanitize_candidates(fallback, "n_rows").first()
    else:
        model, hp = best["model"], best["hp"]
    board = [[r["model"], r["score"]] for r in leaderboard(scores).orderBy("place").collect()]
    summary = (
        spark.range(1)
        .select(selection_summary(F.lit(model), F.lit(hp), F.lit(json.dumps(board))).alias("s"))
        .first()["s"]
    )
    return model, hp, summary


def proposal_prompt(train: DataFrame, *, metadata: str | None = None, head_rows: int = 100) -> DataFrame:
    """One row with the request for candidates, from at least 100 rows of the training table."""
    width = len(train.first()["features"])
    wide = train.select(
        "row_id", "label", *[F.get("features", F.lit(i)).alias(str(i)) for i in range(width)]
    )
    columns = [str(i) for i in range(width)]
    head = wide.withColumn("__target__", F.col("label")).orderBy("row_id").limit(max(100, head_rows))
    records = head.agg(
        F.array_sort(F.collect_list(F.struct("row_id", row_json([*columns, "__target__"]).alias("j")))).alias("r")
    ).select(
        F.concat(F.lit("["), F.array_join(F.transform("r", lambda e: e["j"]), ","), F.lit("]")).alias("rows")
    )
    card = schema_card(wide, "label", columns)
    return card.withColumn("rows", records.scalar()).select(
        prompt_candidates(F.col("card"), F.col("rows"), F.lit(metadata).cast(T.StringType())).alias("prompt")
    )


def propose(train: DataFrame, complete: Complete, *, metadata: str | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """``ord, model, hp, why`` of the candidates in the first usable reply.

    The first request shows the table; while no reply holds a candidate, the short request without the table is sent, up to
    ``attempts`` in all.  Then the safe defaults are taken.
    """
    full = proposal_prompt(train, metadata=metadata)
    short = train.sparkSession.range(1).select(prompt_candidates_minimal().alias("prompt"))
    for attempt in range(attempts):
        replies = score_prompts(full if attempt == 0 else short, complete).select("reply")
        found = stage(parse_candidates(replies, "reply"), "proposed")
        if not found.isEmpty():
            return found
        log.warning("no candidates in reply %d", attempt + 1)
    nothing = train.sparkSession.createDataFrame([("",)], "reply string")
    return parse_candidates(nothing, "reply", defaults=True)


def meta_select(
    train: DataFrame,
    complete: Complete,
    *,
    metadata: str | None = None,
    folds: int = CV_FOLDS,
    max_rows: int = CV_MAX_ROWS,
    calibrated: bool = True,
    open_fits: int = OPEN_FITS,
    baselines: bool = True,
    attempts: int = ATTEMPTS,
):
    """Profile, ask, complete the candidates, cross-validate, fit the best.

    ``train`` has ``row_id, label, features``.  Returns the fitted model, which expects scaled features,
    and the summary.  Without ``baselines`` only what the reply proposes is tried.
    """
    sizes = class_sizes(train)
    n_rows, max_prior = sum(sizes.values()), max(sizes.values()) / sum(sizes.values())
    scaled = stage(standardize(train, train), "scaled")
    group = train.sparkSession.createDataFrame([(0, n_rows, max_prior)], "g int, n_rows bigint, max_prior double")
    proposed = propose(train, complete, metadata=metadata, attempts=attempts).withColumn("g", F.lit(0))
    if baselines:
        pool = candidate_pool(proposed, group, ["g"], "n_rows", "max_prior").drop("g")
    else:
        pool = sanitize_candidates(proposed.withColumn("n_rows", F.lit(n_rows)), "n_rows").select("ord", "model", "hp", "why")
    scores = evaluate_candidates(scaled, pool, folds=folds, max_rows=max_rows, open_fits=open_fits)
    model, hp, summary = choose(scores)
    fitted = fit_candidate(scaled, model, hp)
    if calibrated and len(sizes) > 1:
        try:
            fitted = calibrate(scaled, list(sizes), lambda part: fit_candidate(part, model, hp), n_rows)
        except Exception as error:
            log.warning("calibration failed, using the model as it is: %s", error)
    return fitted, summary


def meta_select_predict(train: DataFrame, test: DataFrame, complete: Complete, **settings) -> DataFrame:
    """The test rows with ``probabilities``, ``pred`` and the ``summary`` of the choice."""
    model, summary = meta_select(train, complete, **settings)
    scaled = standardize(test, train)
    return model.score(scaled).withColumn("summary", F.lit(summary))
