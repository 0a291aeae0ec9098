"""Folds, caps and small balanced samples.  Every choice follows a hash of the row id, so it does
not depend on partitioning and can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabfold.operators.ranking import (
    SEED,
    _number_in_slices,
    hash_slices,
    shuffle_key,
    slice_digits,
    slice_starts,
)


def stratified_kfold(
    df: DataFrame,
    label: str,
    row_id: str,
    folds: int,
    *,
    seed: int = SEED,
    digits: int | None = None,
) -> DataFrame:
    """Add ``fold`` (0-based): rows are dealt out in turn over the table sorted by label and hash.

    Sizes differ by at most one, in every class and in total.  Fails when every class has fewer
    rows than there are folds.
    """
    sliced = hash_slices(df, [label], row_id, seed, slice_digits(df) if digits is None else digits)
    starts = slice_starts(sliced, [label])
    # one row per class from here on
    classes = starts.groupBy(label).agg(F.first("_total").alias("_total"))
    below = Window.orderBy(F.col(label).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = classes.select(
        F.col(label).alias("_label"),
        F.coalesce(F.sum("_total").over(below), F.lit(0)).alias("_below"),
        F.max("_total").over(Window.partitionBy(F.lit(1))).alias("_largest"),
    )
    dealt = starts.join(offsets, starts[label].eqNullSafe(offsets["_label"])).select(
        "_cell",
        F.when(
            F.col("_largest") < folds,
            F.raise_error(F.lit(f"every class has fewer than {folds} rows")),
        )
        .otherwise(F.col("_start") + F.col("_below"))
        .cast("bigint")
        .alias("_start"),
    )
    ranked = _number_in_slices(sliced, dealt, ["_key", row_id], "_rank")
    return ranked.select(*df.columns, ((F.col("_rank") - 1) % folds).cast("int").alias("fold"))


def train_rows(folded: DataFrame, fold: int) -> DataFrame:
    return folded.filter(F.col("fold") != fold)


def test_rows(folded: DataFrame, fold: int) -> DataFrame:
    return folded.filter(F.col("fold") == fold)


def fold_roles(folded: DataFrame, folds: int) -> DataFrame:
    """Each row once per split, with its ``role`` (train or test) in that split."""
    split = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("split")
    role = F.when(F.col("fold") == F.col("split"), "test").otherwise("train").alias("role")
    return folded.select("*", split).withColumn("role", role)


def stratified_cap(
    df: DataFrame,
    label: str,
    row_id: str,
    cap: int,
    *,
    seed: int = SEED,
    digits: int | None = None,
) -> DataFrame:
    """At most about ``cap`` rows with the class shares kept, each class keeping one row or more.

    Slices that lie wholly beyond a class's quota are dropped before anything is shuffled.
    """
    sliced = hash_slices(df, [label], row_id, seed, slice_digits(df) if digits is None else digits)
    starts = slice_starts(sliced, [label])
    classes = starts.groupBy(label).agg(F.first("_total").alias("_class"))
    total = F.sum("_class").over(Window.partitionBy(F.lit(1)))
    share = F.rint(F.col("_class") * (F.lit(float(cap)) / total)).cast("bigint")
    quota = classes.select(
        F.col(label).alias("_label"),
        F.when(total > cap, F.greatest(F.lit(1), share)).otherwise(F.col("_class")).alias("_quota"),
    )
    open_cells = (
        starts.join(quota, starts[label].eqNullSafe(quota["_label"]))
        .filter(F.col("_start") < F.col("_quota"))
        .select("_cell", "_start", "_quota")
    )
    inside = Window.partitionBy("_cell").orderBy("_key", row_id)
    return (
        sliced.join(open_cells, "_cell")
        .withColumn("_pos", F.row_number().over(inside))
        .filter(F.col("_start") + F.col("_pos") <= F.col("_quota"))
        .select(*df.columns)
    )


def class_prototypes(
    df: DataFrame,
    label: str,
    row_id: str,
    *,
    per_class: int = 2,
    max_examples: int = 20,
    seed: int = SEED,
) -> DataFrame:
    """A few rows per class, cut to ``max_examples`` in all; ``position`` gives their order.

    Spark limits each class inside the map tasks, so a hot class ships only ``per_class`` rows each.
    """
    order = Window.partitionBy(label).orderBy(shuffle_key(row_id, seed), row_id)
    picked = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_class).drop("_n")
    cut = picked.orderBy(shuffle_key(row_id, seed), row_id).limit(max_examples)
    whole = Window.partitionBy(F.lit(1)).orderBy(shuffle_key(row_id, seed), row_id)
    return cut.withColumn("position", F.row_number().over(whole))


def context_sample(df: DataFrame, row_id: str, n: int, *, seed: int = SEED) -> DataFrame:
    """``n`` shuffled rows, or all of a smaller table."""
    return df.orderBy(shuffle_key(row_id, seed), row_id).limit(n)
