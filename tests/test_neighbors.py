import tracemalloc

import numpy as np
import pytest

from tabfold.operators import neighbors as N, quantised as Q
from tabfold.operators.vectors import list_pairs, vector_topk, vector_topk_ivf, vector_topk_lsh

SCHEMA = "id bigint, label int, fold int, features array<double>"


def _frame(spark, points, labels=None, folds=None, first=0):
    n = len(points)
    labels = np.arange(n) % 3 if labels is None else labels
    folds = np.arange(n) % 4 if folds is None else folds
    rows = [(first + i, int(labels[i]), int(folds[i]), [float(x) for x in points[i]]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _brute(test, train, k, test_folds=None, train_folds=None):
    out = {}
    for i, t in enumerate(test):
        d = np.sqrt(((train - t) ** 2).sum(axis=1))
        if test_folds is not None:
            d = np.where(train_folds == test_folds[i], np.inf, d)
        order = [j for j in np.lexsort((np.arange(len(d)), d)) if np.isfinite(d[j])][:k]
        out[i] = [(int(j), round(float(d[j]), 9)) for j in order]
    return out


def _found(near):
    out = {}
    for r in sorted(near.collect(), key=lambda r: (r["test_id"], r["rank"])):
        out.setdefault(r["test_id"], []).append((r["train_id"], round(r["dist"], 9)))
    return out


def _points(kind, n=600, d=5, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "random":
        return rng.normal(size=(n, d))
    if kind == "clusters":
        return rng.normal(size=(n, d)) * 0.05 + rng.integers(0, 6, size=(n, 1)) * 3.0
    if kind == "grid":  # many equal distances
        return rng.integers(0, 3, size=(n, d)).astype(float)
    points = rng.normal(size=(n, d))  # a third of the rows is one point
    points[::3] = 0.5
    return points


@pytest.mark.parametrize("kind", ["random", "clusters", "grid", "copies"])
@pytest.mark.parametrize("chunk_rows", [10_000, 40])
def test_search_equals_brute_force(spark, kind, chunk_rows):
    points = _points(kind)
    folds = np.arange(len(points)) % 4
    data = _frame(spark, points, folds=folds)
    near = N.k_nearest(
        data, data, 4, test_id="id", train_id="id", group="fold", payload="label", chunk_rows=chunk_rows, block_rows=64
    )
    assert _found(near) == _brute(points, points, 4, folds, folds)


@pytest.mark.parametrize("chunk_rows", [10_000, 15])
def test_more_neighbours_than_rows(spark, chunk_rows):
    points = _points("random", n=40)
    near = N.k_nearest(
        _frame(spark, points[:7]), _frame(spark, points), 60, test_id="id", train_id="id", chunk_rows=chunk_rows
    )
    assert _found(near) == _brute(points[:7], points, 60)


def test_missing_features_are_refused(spark):
    data = _frame(spark, np.array([[1.0, float("nan")], [0.0, 1.0]]))
    with pytest.raises(Exception, match="missing values"):
        N.k_nearest(data, data, 1, test_id="id", train_id="id").collect()


def test_kernel_with_large_offsets():
    # the fast pass loses digits here; the exact pass must not
    rng = np.random.default_rng(3)
    train = rng.normal(size=(300, 8)) + 1e6
    test = rng.normal(size=(20, 8)) + 1e6
    i, j, d = N.best_in_chunk(test, train, 5)
    expected = _brute(test, train, 5)
    got = {}
    for a, b, c in zip(i, j, d):
        got.setdefault(int(a), []).append((int(b), round(float(c), 9)))
    assert got == expected


@pytest.mark.parametrize("copies", [1, 1024])
def test_kernel_holds_few_matrices_of_pairs(copies):
    rng = np.random.default_rng(8)
    train, test = np.repeat(rng.normal(size=(16384 // copies, 64)), copies, axis=0), rng.normal(size=(512, 64))
    tracemalloc.start()
    i, j, d = N.best_in_chunk(test, train, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # a matrix of pairs is 16 MB
    expected = _brute(test[:40], train, 5)
    for row in range(40):
        assert [(int(b), round(float(c), 9)) for b, c in zip(j[i == row], d[i == row])] == expected[row]


def test_votes(spark):
    rows = [(1, 0.5, 7), (1, 0.5, 9), (1, 2.0, 9), (1, 2.0, 7), (2, 0.0, 5), (2, 0.1, 4), (2, 0.1, 4), (3, 1.0, 8), (3, 3.0, 2), (3, 3.0, 2)]
    near = spark.createDataFrame(rows, "test_id int, dist double, payload int")
    uniform = {r["test_id"]: r["pred"] for r in N.vote_uniform(near).collect()}
    weighted = {r["test_id"]: r["pred"] for r in N.vote_distance(near).collect()}
    assert uniform == {1: 7, 2: 4, 3: 2}  # ties go to the smaller label
    assert weighted == {1: 7, 2: 5, 3: 8}  # distance 0 outvotes, then 1/d


def test_neighbour_lists_are_ordered(spark):
    points = _points("random", n=50)
    data = _frame(spark, points)
    near = N.k_nearest(data, data, 3, test_id="id", train_id="id", group="fold")
    lists = N.neighbor_lists(N.neighbor_rows(near, data, "id", ["features", "label"]), ["features", "label"])
    for row in lists.collect():
        assert [n["rank"] for n in row["neighbors"]] == [1, 2, 3]
        for n in row["neighbors"]:
            assert list(n["features"]) == list(points[n["train_id"]])


def test_hash_buckets_recall(spark):
    points = _points("clusters", n=800)
    data = _frame(spark, points)
    names = dict(query_id="id", stored_id="id", embedding="features")
    exact = {(r["test_id"], r["train_id"]) for r in vector_topk(data, data, 5, **names).collect()}
    found = vector_topk_lsh(data, data, 5, **names, bucket_length=0.3, chunk_rows=30, block_rows=50)
    rows = found.collect()
    assert len({(r["test_id"], r["rank"]) for r in rows}) == len(rows)
    assert len(exact & {(r["test_id"], r["train_id"]) for r in rows}) / len(exact) > 0.9


def test_codes_bound_the_distances():
    rng = np.random.default_rng(5)
    for scale in (1e-3, 1.0, 1e6):
        test, train = rng.normal(size=(40, 16)) * scale + 7 * scale, rng.normal(size=(300, 16)) * scale
        pivots = train[:2]
        coded = [Q.Coded(*Q.encode(points, pivot), pivot) for points, pivot in ((test, pivots[0]), (train, pivots[1]))]
        i, j, low, high = Q.candidates(*coded, 5)
        exact = np.sqrt(((test[i] - train[j]) ** 2).sum(axis=1))
        assert (low <= exact).all() and (exact <= high).all()
        best = _brute(test, train, 5)
        pairs = set(zip(i.tolist(), j.tolist()))
        assert all((a, b) in pairs for a, near in best.items() for b, _ in near)
        assert len(pairs) < 0.2 * 40 * 300


def test_few_exact_distances_on_unclustered_vectors(spark):
    """In 64 dimensions no ring can be ruled out; the codes leave few pairs to measure."""
    points = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = points.selectExpr("vec_id AS test_id", "vec_id AS train_id", "cast(embedding AS array<double>) AS features", "vec_id % 5 AS grp")
    n = rows.count()
    pairs = Q.scan(rows.drop("train_id"), rows.drop("test_id"), 3, n, 64, 64)
    assert 3 * n <= pairs.count() < 0.2 * n * n * 0.8


def test_blocks_and_not_rows_are_copied(spark):
    """The scan ships packed codes: no test row is joined to chunks by itself."""
    data = _frame(spark, _points("random", n=300))
    near = N.k_nearest(data, data, 3, test_id="id", train_id="id", group="fold", chunk_rows=40, block_rows=64)
    assert near.count() == 900


@pytest.mark.parametrize("chunk_rows", [10_000, 30])
def test_odd_neighbour_tables(spark, chunk_rows):
    points = np.vstack([np.zeros((50, 3)), np.full((50, 3), 1e9), np.eye(3) * 1e-9])
    data = _frame(spark, points)
    names = dict(test_id="id", train_id="id", chunk_rows=chunk_rows, block_rows=16)
    assert _found(N.k_nearest(data, data, 4, **names)) == _brute(points, points, 4)
    assert N.k_nearest(data.limit(0), data, 4, **names).count() == 0
    assert N.k_nearest(data, data.limit(0), 4, **names).count() == 0
    texts = data.withColumn("id", data["id"].cast("string"))
    assert N.k_nearest(texts, texts, 2, **names).count() == 2 * len(points)


def test_popular_neighbours_are_spread(spark):
    """One training row is the nearest of all; no task of the join reads all its rows."""
    points = np.vstack([np.zeros((1, 2)), np.random.default_rng(1).normal(size=(4000, 2)) + 50])
    data = _frame(spark, points)
    near = spark.range(1, 4001).selectExpr("id AS test_id", "0L AS train_id", "1.0D AS dist", "1 AS rank", "0 AS payload")
    joined = N.neighbor_rows(near, data, "id", ["features", "label"])
    assert joined.count() == 4000 and joined.where("label = 0").count() == 4000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_lists_recall_and_cost(spark):
    points = _points("clusters", n=1200)
    data = _frame(spark, points)
    names = dict(query_id="id", stored_id="id", embedding="features")
    exact = {(r["test_id"], r["train_id"]) for r in vector_topk(data, data, 5, **names).collect()}
    rows = vector_topk_ivf(data, data, 5, **names, lists=24, nprobe=6, chunk_rows=40, block_rows=50).collect()
    assert len({(r["test_id"], r["rank"]) for r in rows}) == len(rows) == 5 * 1200
    assert len(exact & {(r["test_id"], r["train_id"]) for r in rows}) / len(exact) > 0.9
    every = vector_topk_ivf(data, data, 5, **names, lists=24, nprobe=24, chunk_rows=40, block_rows=50).collect()
    assert {(r["test_id"], r["train_id"]) for r in every} == exact
    assert list_pairs(data, data, 5, **names, lists=24, nprobe=6).count() < 0.1 * 1200 * 1200


def test_chunks_grow_with_the_table(spark, monkeypatch):
    """A small ``chunk_rows`` must not cut a large table into chunks by the hundred: each is met by every block."""
    met = []
    real = Q._meet
    monkeypatch.setattr(Q, "_meet", lambda blocks, chunks, *rest: (met.append((blocks.count(), chunks.count())), real(blocks, chunks, *rest))[1])
    points = _points("random", n=3000)
    data = _frame(spark, points)
    near = N.k_nearest(data, data, 3, test_id="id", train_id="id", group="fold", chunk_rows=8, block_rows=8)
    folds = np.arange(len(points)) % 4
    assert _found(near) == _brute(points, points, 3, folds, folds)
    assert all(blocks <= 2 * Q.BLOCKS and chunks <= 4 * Q.CHUNKS for blocks, chunks in met)


@pytest.mark.parametrize("grouped", [False, True])
def test_bounded_rows_leave_few_pairs(grouped):
    """With and without a known bound: all true neighbours, and little more, leave the kernel."""
    rng = np.random.default_rng(9)
    test, train = rng.normal(size=(60, 32)), rng.normal(size=(9000, 32))
    groups = (np.arange(60) % 3, np.arange(9000) % 3) if grouped else (None, None)
    coded = [Q.Coded(*Q.encode(points, pivot), pivot, g) for points, pivot, g in ((test, train[0], groups[0]), (train, train[1], groups[1]))]
    best = _brute(test, train, 6, *groups)
    bounds = np.array([near[-1][1] + 1e-3 for near in best.values()])
    bounds[::7] = np.inf
    for bound in (None, bounds):
        i, j, _, _ = Q.candidates(*coded, 6, bound)
        pairs = set(zip(i.tolist(), j.tolist()))
        assert all((a, b) in pairs for a, near in best.items() for b, _ in near)
        assert len(pairs) < 1.5 * 6 * 60


def test_the_registered_lists_are_scanned_once(spark, monkeypatch):
    """Pairs are made once, for the queries of the contract against all vectors."""
    from tabfold.registry import search

    made, real = [], search.list_pairs
    monkeypatch.setattr(search, "list_pairs", lambda queries, stored, *a, **b: (made.append((queries.count(), stored.count())), real(queries, stored, *a, **b))[1])
    [row] = search.vector_topk_ivf(spark, "/root/testdata/sf0.01").collect()
    assert made == [(10, 500)] and all(row)


def test_copies_of_a_test_row_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    points = rng.normal(size=(60, 3))[rng.integers(0, 60, 900)]
    data = spark.createDataFrame([(i, i % 3, p.tolist()) for i, p in enumerate(points)], "id int, fold int, features array<double>")
    searched = []
    scan = N.scan
    monkeypatch.setattr(N, "scan", lambda left, *rest: (searched.append(left.count()), scan(left, *rest))[1])
    near = N.k_nearest(data, data, 4, test_id="id", train_id="id", group="fold", payload="fold", chunk_rows=50, block_rows=40)
    rows = near.collect()
    assert searched and searched[0] <= 180, "60 points in three folds"
    assert len(rows) == 3600
    for r in rows:
        held = [j for j in range(900) if j % 3 != r["test_id"] % 3]
        gaps = np.sqrt(((points[held] - points[r["test_id"]]) ** 2).sum(axis=1))
        order = sorted(zip(gaps.tolist(), held))
        assert (r["dist"], r["train_id"]) == order[r["rank"] - 1] and r["payload"] == r["train_id"] % 3


def test_few_pairs_are_measured_in_two_dimensions(monkeypatch):
    """Points far from the pivot beside their gaps: single precision leaves most of a neighbourhood open."""
    rng = np.random.default_rng(2)
    points = np.stack([rng.integers(0, 25, 5000).astype(float), rng.uniform(-1000, 10000, 5000)], axis=1)
    coded = Q.Coded(*Q.encode(points, points[0]), points[0])
    left_open = []
    pick = np.flatnonzero
    monkeypatch.setattr(Q.np, "flatnonzero", lambda a: (left_open.append(np.count_nonzero(a)) if a.ndim == 2 else None, pick(a))[1])
    exact = np.sqrt(((points[:200, None] - points[None]) ** 2).sum(axis=2))
    bound = np.sort(exact, axis=1)[:, 2]
    test = Q.Coded(coded.codes[:200], coded.step[:200], coded.left_out[:200], coded.pivot)
    i, j, _, _ = Q.candidates(test, coded, 3, bound)
    assert sum(left_open) < 200 * 6
    found = set(zip(i.tolist(), j.tolist()))
    assert all((a, int(b)) in found for a in range(200) for b in np.argsort(exact[a], kind="stable")[:3])

    left_open.clear()  # a loose bound is made tight by some of the rows
    again = set(zip(*(a.tolist() for a in Q.candidates(test, coded, 3, np.full(200, 5000.0))[:2])))
    assert sum(left_open) < 200 * 50
    assert all((a, int(b)) in again for a in range(200) for b in np.argsort(exact[a], kind="stable")[:3])
