"""Preparation of raw tables: positions, booleans, one-hot columns, thresholds, scaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabfold.functions.text import row_json, variant_row
from tabfold.workspace import stage

MAX_CATEGORIES = 512


def split_target(df: DataFrame, target: int, *, carry: list[str] | None = None, typed: bool = False) -> DataFrame:
    """``label`` from the column at position ``target``, all others as ``features`` (doubles).

    Columns named in ``carry`` (a row id) keep their names and take no part in the positions.  With ``typed`` a column ``row``
    (VARIANT) holds the other columns by name, as they are: prompts then show 13 as 13, and texts as texts, which are
    gaps among the features.
    """
    carry = carry or []
    names = [c for c in df.columns if c not in carry]
    if not 0 <= target < len(names):
        raise IndexError(f"no column at position {target}")
    others = [c for i, c in enumerate(names) if i != target]
    features = [F.col(f"`{c}`").try_cast("double") if typed else F.col(f"`{c}`").cast("double") for c in others]
    row = [variant_row(others).alias("row")] if typed else []
    return df.select(
        *carry, F.col(f"`{names[target]}`").alias("label"), F.array(*features).alias("features"), *row
    )


def drop_by_position(df: DataFrame, position: int | None) -> DataFrame:
    """Drop the column at a position; a position outside the table changes nothing."""
    if position is None or not 0 <= position < len(df.columns):
        return df
    return df.drop(df.columns[position])


def positional_rename(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(i) for i in range(len(df.columns))])


def _key_after(df: DataFrame, n: int, order: str) -> Column:
    """The key of row ``n + 1`` by a unique, orderable column.

    The keys alone are dealt into sampled ranges; the sizes of the ranges tell which one holds the key, and
    no task sorts more than a range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(order).alias("key")).repartitionByRange(ranges, "key")
    keys = stage(keys.withColumn("part", F.spark_partition_id()), "keys")
    sizes = sorted((r["part"], r["count"]) for r in keys.groupBy("part").count().collect())  # one row a range
    left = n
    for part, size in sizes:
        if left < size:
            inside = keys.filter(F.col("part") == part).orderBy(F.col("key").asc_nulls_first())
            return inside.limit(left + 1).agg(F.max("key").alias("first")).scalar()
        left -= size
    raise IndexError(f"the table has no more than {n} rows")


def skip_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """All rows but the first ``n`` by ``order`` (a unique, orderable column); ``n`` below the row count.

    A filter on the first key to keep; the rows stay where they are.
    """
    if n < 0:
        raise IndexError("cannot skip a negative number of rows")
    if n == 0:
        return df
    return df.filter(F.col(order) >= _key_after(df, n, order))


def head_fraction(df: DataFrame, share: float, order: str) -> DataFrame:
    """The first ``int(rows * share)`` rows by ``order`` (a unique, orderable column); all if share >= 1."""
    if share >= 1.0:
        return df
    wanted = int(df.count() * float(share))
    if wanted == 0:
        return df.filter(F.lit(False))
    return df.filter(F.col(order) < _key_after(df, wanted, order))


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def bool_text_to_int(df: DataFrame) -> DataFrame:
    """String columns holding nothing but ``True``/``False`` (and gaps) become 1/0."""
    columns = _strings(df)
    if not columns:
        return df
    tests = [
        F.coalesce(F.bool_and(F.col(f"`{c}`").isin("True", "False")), F.lit(True)).alias(str(i))
        for i, c in enumerate(columns)
    ]
    verdict = df.agg(*tests).first()
    flags = {c for i, c in enumerate(columns) if verdict[i]}
    return df.select(
        *[
            F.when(F.col(f"`{c}`") == "True", 1).when(F.col(f"`{c}`") == "False", 0).alias(c)
            if c in flags
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def bool_to_int(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("int").alias(f.name)
            if isinstance(f.dataType, T.BooleanType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def categories(df: DataFrame, columns: list[str], *, limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct values per column.

    One pass for all columns; only distinct values are shuffled, and never more than ``limit`` + 1
    per column reach the driver.
    """
    if not columns:
        return {}
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v"))
                for i, c in enumerate(columns)
            ]
        )
    ).alias("pair")
    distinct = df.select(pairs).select("pair.i", "pair.v").filter("v is not null").distinct()
    first = Window.partitionBy("i").orderBy("v")
    bounded = distinct.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit + 1)
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in bounded.collect():
        found[columns[row["i"]]].append(row["v"])
    for column, values in found.items():
        if len(values) > limit:
            raise ValueError(f"column {column!r} has more than {limit} categories")
        values.sort(key=lambda v: v.encode())
    return found


def one_hot_encode(
    df: DataFrame, columns: list[str] | None = None, *, limit: int = MAX_CATEGORIES
) -> DataFrame:
    """0/1 columns ``name_value`` per category but the first; they follow the untouched columns."""
    columns = _strings(df) if columns is None else columns
    values = categories(df, columns, limit=limit)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    encoded = [
        F.col(f"`{c}`").cast("string").eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}")
        for c in columns
        for v in values[c][1:]
    ]
    return df.select(*kept, *encoded)


def threshold_binarize(df: DataFrame, position: int | None, threshold: float) -> DataFrame:
    """Column at a position becomes 1 where it reaches the threshold, else (and for gaps) 0."""
    if position is None or not 0 <= position < len(df.columns):
        return df
    name = df.columns[position]
    reached = F.coalesce(F.col(f"`{name}`") >= F.lit(threshold), F.lit(False)).cast("int")
    return df.select(*[reached.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def encode_table(
    df: DataFrame,
    *,
    remove: int | None = None,
    target: int | None = None,
    threshold: float = 10,
    limit: int = MAX_CATEGORIES,
) -> DataFrame:
    """The whole cleaning job: drop, booleans, one-hot, threshold, in this order."""
    df = bool_text_to_int(drop_by_position(df, remove))
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    gaps: set[str] = set()
    if flags:
        missing = df.agg(
            *[F.bool_or(F.col(f"`{c}`").isNull()).alias(str(i)) for i, c in enumerate(flags)]
        ).first()
        gaps = {c for i, c in enumerate(flags) if missing[i]}
    # a boolean column with gaps counts as a category column with the values False and True
    df = df.select(
        *[
            F.initcap(F.col(f"`{c}`").cast("string")).alias(c) if c in gaps else F.col(f"`{c}`")
            for c in df.columns
        ]
    )
    return threshold_binarize(bool_to_int(one_hot_encode(df, limit=limit)), target, threshold)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, the only mark of a missing value in this library."""
    return df.select(
        *[
            F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def head_records_json(df: DataFrame, n: int, order: str, columns: list[str]) -> DataFrame:
    """First ``max(100, n)`` rows by ``order`` as JSON objects, with their 1-based ``position``."""
    head = df.orderBy(order).limit(max(100, n))
    place = Window.partitionBy(F.lit(1)).orderBy(order)
    return head.select(F.row_number().over(place).alias("position"), row_json(columns).alias("record"))


def _moments(by: list[str], features: str):
    """Task that sums up its rows: one row per group with counts, means and squared deviations by position.

    Batches are merged as means and deviations, not as sums of squares, which lose digits.
    """

    def merge(kept: tuple | None, new: tuple) -> tuple:
        if kept is None:
            return new
        size = max(len(kept[0]), len(new[0]))
        (n1, m1, d1), (n2, m2, d2) = [[np.pad(x, (0, size - len(x))) for x in part] for part in (kept, new)]
        n = n1 + n2
        share = np.divide(n2, n, out=np.zeros(size), where=n > 0)
        gap = m2 - m1
        return n, m1 + gap * share, d1 + d2 + gap * gap * n1 * share

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple] = {}
        kinds = None
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(features)))
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in by]
            kinds = [k.type for k in keys]
            named = list(zip(*[k.to_pylist() for k in keys])) if by else [()] * batch.num_rows
            numbers = {key: i for i, key in enumerate(dict.fromkeys(named))}
            group = np.array([numbers[key] for key in named])
            column = batch.column(features)
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            width = int(lengths.max(initial=0))
            place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            cell = np.repeat(group, lengths) * width + place
            there = ~np.isnan(values)
            cell, values = cell[there], values[there]
            cells = width * len(numbers)
            n = np.bincount(cell, minlength=cells).astype(np.float64)
            mean = np.divide(np.bincount(cell, values, cells), n, out=np.zeros(cells), where=n > 0)
            gap = values - mean[cell]
            # what rounding left in the mean
            mean += np.divide(np.bincount(cell, gap, cells), n, out=np.zeros(cells), where=n > 0)
            gap = values - mean[cell]
            squares = np.bincount(cell, gap * gap, cells)
            widest = np.zeros(len(numbers), np.int64)
            np.maximum.at(widest, group, lengths)
            for key, i in numbers.items():
                part = slice(i * width, i * width + int(widest[i]))
                kept[key] = merge(kept.get(key), (n[part], mean[part], squares[part]))
        if kept:
            columns = [pa.array([key[i] for key in kept], kind) for i, kind in enumerate(kinds)]
            columns += [pa.array([part[i].tolist() for part in kept.values()], pa.list_(pa.float64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, [*by, "_n", "_mean", "_squares"])

    return task


def feature_stats(df: DataFrame, features: str, by: list[str] | None = None) -> DataFrame:
    """Rows, mean and population variance per feature position (``pos``), gaps left out.

    Each task sums up its rows in one buffer by position, so only tasks x groups x features values are shuffled and no row
    is spread over its features.
    """
    by = by or []
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([df.schema[c] for c in by] + [T.StructField(n, numbers) for n in ("_n", "_mean", "_squares")])
    rows = df.select(*by, F.col(features).cast("array<double>").alias(features))
    parts = rows.mapInArrow(_moments(by, features), schema)
    entry = F.arrays_zip("_n", "_mean", "_squares")
    values = parts.select(*by, F.posexplode(entry).alias("pos", "s")).select(*by, "pos", "s._n", "s._mean", "s._squares")
    keys = [*by, "pos"]
    whole = Window.partitionBy(*keys)
    total = F.sum("_n").over(whole)
    center = F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.when(total > 0, total)
    values = values.withColumn("_total", total).withColumn("_center", center).withColumn("_off", F.col("_mean") - F.col("_center"))
    return values.groupBy(*keys).agg(
        F.sum("_n").cast("bigint").alias("n"),
        F.first("_center").alias("mean"),
        F.sum((F.col("_squares") + F.col("_n") * F.col("_off") * F.col("_off")) / F.when(F.col("_total") > 0, F.col("_total"))).alias("var"),
    )


def _scale_arrays(stats: DataFrame, by: list[str]) -> DataFrame:
    std = F.sqrt("var")
    entry = F.struct(
        "pos",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(std > 0, std).otherwise(1.0).alias("std"),
    )
    arrays = stats.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("_scale"))
    return arrays


def _scaled(features: str) -> Column:
    return F.zip_with(features, "_scale", lambda x, s: (x - s["mean"]) / s["std"])


def standardize(df: DataFrame, fitted_on: DataFrame, features: str = "features") -> DataFrame:
    """(x - mean) / population std of the ``fitted_on`` frame; a zero std counts as 1."""
    scale = _scale_arrays(feature_stats(fitted_on, features), [])
    return df.withColumn("_scale", scale.scalar()).withColumn(features, _scaled(features)).drop("_scale")


def standardize_folds(folded: DataFrame, folds: int, features: str = "features") -> DataFrame:
    """Every row once per ``split``, scaled by the rows outside that split's test fold.

    One pass gives the moments of each fold; those of a training part are put together from the
    moments of its folds, which is exact and stays stable, unlike sums of squares.
    """
    parts = feature_stats(folded, features, ["fold"])
    split = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("split")
    trained = parts.select("*", split).filter(F.col("split") != F.col("fold"))
    # folds x folds x features rows from here on
    both = ["split", "pos"]
    whole = Window.partitionBy(*both)
    merged = (
        trained.withColumn("all_n", F.sum("n").over(whole))
        .withColumn("all_mean", F.sum(F.col("n") * F.col("mean")).over(whole) / F.col("all_n"))
        .withColumn("off", F.col("mean") - F.col("all_mean"))
        .groupBy(*both)
        .agg(
            F.first("all_mean").alias("mean"),
            F.sum(F.col("n") / F.col("all_n") * (F.col("var") + F.col("off") * F.col("off"))).alias("var"),
        )
    )
    scale = _scale_arrays(merged, ["split"])  # one row per fold
    rows = folded.select("*", split)
    role = F.when(F.col("fold") == F.col("split"), "test").otherwise("train")
    return (
        rows.join(F.broadcast(scale), "split")  # ``folds`` rows
        .withColumn(features, _scaled(features))
        .drop("_scale")
        .withColumn("role", role)
    )
