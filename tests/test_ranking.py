import hashlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from tabfold.operators import ranking as R
from tabfold.operators import sampling as S


def _key(i, seed=42):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds two thirds of the rows, one is tiny, one is missing."""
    rows = [(i, "big" if i % 3 else ("small" if i % 30 else None)) for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, label string")


def test_rank_by_hash(skewed):
    got = R.rank_by_hash(skewed, ["label"], "id").toPandas()
    for _, group in got.groupby("label", dropna=False):
        ordered = group.assign(h=[_key(i) for i in group["id"]]).sort_values("h")
        assert list(ordered["rank"]) == list(range(1, len(group) + 1))


def test_rank_by_value(skewed):
    spread = skewed.withColumn("id", F.col("id") * F.col("id") - 500)
    got = R.rank_by_value(spread, ["label"], "id", slices=16).toPandas()
    expected = got.groupby("label", dropna=False)["id"].rank().astype(int)
    assert (got["rank"] == expected).all()


def test_rank_of_empty_table(skewed):
    assert R.rank_by_value(skewed.filter("id < 0"), ["label"], "id").count() == 0


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_folds_do_not_depend_on_partitions(skewed, partitions):
    dealt = S.stratified_kfold(skewed.repartition(partitions), "label", "id", 5).toPandas()
    ordered = sorted(
        skewed.toPandas().itertuples(index=False),
        key=lambda r: (r.label is not None, r.label or "", _key(r.id)),
    )
    expected = {r.id: i % 5 for i, r in enumerate(ordered)}
    assert dict(zip(dealt["id"], dealt["fold"])) == expected


@settings(
    max_examples=5,
    deadline=None,
    phases=[Phase.explicit, Phase.reuse, Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    sizes=st.lists(st.integers(1, 40), min_size=1, max_size=4).filter(lambda s: max(s) >= 7),
    folds=st.integers(2, 7),
)
def test_fold_sizes_are_even(spark, sizes, folds):
    rows = [(i, c) for c, n in enumerate(sizes) for i in range(c * 1000, c * 1000 + n)]
    dealt = S.stratified_kfold(spark.createDataFrame(rows, "id int, label int"), "label", "id", folds).toPandas()
    assert len(dealt) == len(rows) and dealt["id"].is_unique
    everywhere = pd.crosstab(dealt["label"], dealt["fold"]).reindex(columns=range(folds), fill_value=0)
    assert (everywhere.max(axis=1) - everywhere.min(axis=1)).max() <= 1
    assert everywhere.sum().max() - everywhere.sum().min() <= 1


def test_too_few_rows_for_the_folds(spark):
    with pytest.raises(Exception, match="fewer than 5 rows"):
        S.stratified_kfold(spark.range(8).withColumn("label", F.col("id") % 3), "label", "id", 5).collect()


def test_fold_roles_cover_each_split(skewed):
    roles = S.fold_roles(S.stratified_kfold(skewed, "label", "id", 4), 4).toPandas()
    assert (roles.groupby("split").size() == 3000).all()
    assert (roles[roles.role == "test"].groupby("id").size() == 1).all()


def test_cap_keeps_shares_and_every_class(spark):
    rows = [(i, 0 if i < 1990 else i - 1989) for i in range(2000)]
    capped = S.stratified_cap(spark.createDataFrame(rows, "id int, label int"), "label", "id", 100).toPandas()
    sizes = capped["label"].value_counts()
    # round(1990 * 0.05) is 100 (half to even), and the ten single rows stay
    assert sizes[0] == round(1990 * 0.05) and len(sizes) == 11
    best = sorted(range(1990), key=_key)[: sizes[0]]
    assert sorted(capped[capped.label == 0]["id"]) == sorted(best)


def test_no_cap_below_the_limit(skewed):
    assert S.stratified_cap(skewed, "label", "id", 3000).count() == 3000


def test_prototypes_are_balanced(skewed):
    picked = S.class_prototypes(skewed, "label", "id", per_class=2, max_examples=5).toPandas()
    assert sorted(picked["position"]) == [1, 2, 3, 4, 5]
    assert picked["label"].value_counts(dropna=False).max() == 2
