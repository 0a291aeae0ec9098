"""Moments and profiles: no row is spread over its columns."""

import math

import numpy as np
from pyspark.sql import functions as F

from tabfold.operators import profiling as R
from tabfold.operators.cleaning import feature_stats, standardize


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_moments_with_gaps_and_uneven_rows(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(500):
        x = [float(v) for v in rng.normal(size=3) + 1e8]
        x[i % 3] = [float("nan"), None, 5.0][i % 3]
        rows.append((i % 4, x if i % 50 else None))
    rows += [(9, [None, None]), (9, []), (4, [1.0, 2.0, 3.0, 4.0])]
    data = spark.createDataFrame(rows, "fold int, features array<double>").repartition(6)
    for by in ([], ["fold"]):
        got = {(*[r[c] for c in by], r["pos"]): (r["n"], r["mean"], r["var"]) for r in feature_stats(data, "features", by).collect()}
        cells = {}
        for fold, x in rows:
            for p, v in enumerate(x or []):
                cells.setdefault((fold, p) if by else (p,), []).extend([] if v is None or math.isnan(v) else [v])
        assert set(got) == set(cells)
        for key, values in cells.items():
            n, mean, var = got[key]
            assert n == len(values)
            if values:
                assert math.isclose(mean, np.mean(values), rel_tol=1e-12)
                assert math.isclose(var, np.var(values), rel_tol=1e-6, abs_tol=1e-9)
            else:
                assert mean is None and var is None


def test_moments_do_not_explode_rows(spark):
    data = spark.range(1000).select(F.array(*[F.col("id").cast("double")] * 20).alias("features"))
    plan = _plan(feature_stats(data, "features"))
    assert plan.index("Generate") < plan.index("MapInArrow")  # below it only the rows themselves
    assert standardize(data, data).select(F.abs(F.avg(F.element_at("features", 20))) < 1e-9).first()[0]


def test_profile_of_all_types(spark):
    data = spark.sql(
        """SELECT id % 7 AS a, CASE WHEN id % 3 = 0 THEN double('NaN') WHEN id % 3 = 1 THEN 0.0D ELSE -0.0D END AS b,
           CASE WHEN id % 2 = 0 THEN string(id) END AS c, id % 2 = 0 AS d, date_add(date'2020-01-01', int(id % 5)) AS e,
           cast(null AS string) AS f, cast(id % 4 AS decimal(10, 2)) AS g, array(id % 2, 1) AS h, x'0aff' AS i
           FROM range(3000)"""
    ).repartition(7)
    got = {r["name"]: (r["idx"], r["n_unique"], r["missing_pct"]) for r in R.column_profile(data).collect()}
    assert got == {
        "a": (0, 7, 0.0), "b": (1, 1, 0.333333), "c": (2, 1500, 0.5), "d": (3, 2, 0.0), "e": (4, 5, 0.0), "f": (5, 0, 1.0),
        "g": (6, 4, 0.0), "h": (7, 2, 0.0), "i": (8, 1, 0.0),
    }
    assert "Expand" not in _plan(R.column_profile(data))
    assert [r["n_unique"] for r in R.column_profile(data.limit(0), ["a", "c"]).collect()] == [0, 0]


def test_profile_gives_out_held_values(spark, monkeypatch):
    monkeypatch.setattr(R, "HELD_VALUES", 50)
    data = spark.range(20_000).select((F.col("id") % 700).alias("x"), (F.col("id") % 3).alias("y"))
    assert {r["name"]: r["n_unique"] for r in R.column_profile(data).collect()} == {"x": 700, "y": 3}


def test_sketches_of_parts_merge(spark):
    data = spark.range(40_000).select((F.col("id") % 9000).alias("x"), F.when(F.col("id") % 4 > 0, F.col("id")).alias("y"))
    parts = [data.where(f"x % 3 = {i}") for i in range(3)]
    kept = R.profile_sketches(parts[0]).unionByName(R.profile_sketches(parts[1])).unionByName(R.profile_sketches(parts[2]))
    for frame in (R.profile_of_sketches(kept), R.column_profile(data, approximate=True)):
        got = {r["name"]: r for r in frame.collect()}
        assert abs(got["x"]["n_unique"] / 9000 - 1) < 0.03 and abs(got["y"]["n_unique"] / 30_000 - 1) < 0.03
        assert got["y"]["missing_pct"] == 0.25 and got["x"]["idx"] == 0
    by_day = R.profile_sketches(data, ["x"], by=[F.col("y") % 2])
    assert by_day.columns[0] == "_by0" and R.profile_of_sketches(by_day.drop("_by0")).first()["n_unique"] > 8700


def test_schema_card_refuses_many_labels(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(R, "MAX_LABELS", 5)
    data = spark.range(20).select(F.col("id").alias("label"), F.lit(1.0).alias("x"))
    with pytest.raises(Exception, match="more than 5 labels"):
        R.schema_card(data, "label", ["x"]).collect()
    R.schema_card(data.where("label < 5"), "label", ["x"]).collect()
