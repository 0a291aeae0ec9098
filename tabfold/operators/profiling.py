"""Label spaces, class shares, column profiles, schema cards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabfold.operators.ranking import rank_by_value

MAX_LABELS = 100_000
#: Distinct values that a task holds while it profiles its rows.
HELD_VALUES = 200_000
#: Logarithm of the cells of a distinct-count sketch: 16,384 cells err by about one in a hundred.
SKETCH_BITS = 14

# Names of the column types in a profile.
DTYPE_NAMES = {
    "boolean": "bool",
    "tinyint": "int8",
    "smallint": "int16",
    "int": "int32",
    "bigint": "int64",
    "float": "float32",
    "double": "float64",
    "string": "object",
    "timestamp": "datetime64[ns]",
    "date": "object",
}


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """One row per label; everything about classes starts from here."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_space(df: DataFrame, label: str) -> DataFrame:
    """All labels as one sorted array; refuses a column with too many values to be a class label."""
    known = label_counts(df, label).select("label").filter(F.col("label").isNotNull())
    some = known.limit(MAX_LABELS + 1)
    labels = F.array_sort(F.collect_list("label"))
    many = F.raise_error(F.lit(f"more than {MAX_LABELS} labels"))
    return some.agg(F.when(F.count("label") > MAX_LABELS, many).otherwise(labels).alias("labels"))


def class_priors(df: DataFrame, label: str) -> DataFrame:
    """Share of each class in all rows, rows without a label included in the total."""
    everything = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return (
        label_counts(df, label)
        .select("label", "n", (F.col("n") / everything).alias("prior"))
        .filter(F.col("label").isNotNull())
    )


def max_class_prior(df: DataFrame, label: str) -> DataFrame:
    """Share of the largest class among the labelled rows."""
    known = label_counts(df, label).filter(F.col("label").isNotNull())
    return known.agg((F.max("n") / F.sum("n")).alias("max_prior"))


def _missing(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _comparable(field: T.StructField) -> Column:
    """The value as a text that differs where the value does, null where it is missing."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0.0).cast(field.dataType)  # the two zeros are one value
    elif isinstance(field.dataType, T.BinaryType):
        value = F.hex(value)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        value = F.to_json(F.struct(value))
    return F.when(~_missing(field), value.cast("string"))


def _distinct_in_task(limit: int):
    """Task over text columns: the distinct values of each (``idx, value``), and its missing values (``value`` null, ``n``).

    Values seen are held up to ``limit`` over all columns, then given out and forgotten, so a task may repeat some.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["idx", "value", "rows", "missing"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        held: dict[int, pa.Array] = {}
        rows, missing = 0, []

        def told() -> pa.RecordBatch:
            idx = np.concatenate([np.full(len(v), i, np.int32) for i, v in held.items()])
            values = pa.concat_arrays([v.cast(pa.string()) for v in held.values()])
            zeros = np.zeros(len(idx), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(idx), values, pa.array(zeros), pa.array(zeros)], names)

        for batch in batches:
            rows += batch.num_rows
            missing = missing or [0] * batch.num_columns
            for i, column in enumerate(batch.columns):
                missing[i] += column.null_count
                new = pc.drop_null(pc.unique(column))
                held[i] = pc.unique(pa.concat_arrays([held[i], new])) if i in held else new
            if sum(map(len, held.values())) > limit:
                yield told()
                held = {}
        if held:
            yield told()
        count = len(missing)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip([range(count), [None] * count, [rows] * count, missing], kinds)], names
        )

    return task


def column_profile(df: DataFrame, columns: list[str] | None = None, *, approximate: bool = False) -> DataFrame:
    """``idx, name, dtype, n_unique, missing_pct`` per column, all columns in one pass.

    Exact distinct counts shuffle the distinct values that each task has seen, as one long table of column and value;
    ``approximate`` counts by sketches of fixed size, which is the setting for very large tables of mostly distinct values.
    """
    fields = [df.schema[c] for c in (columns or df.columns)]
    if approximate:
        return profile_of_sketches(profile_sketches(df, columns))
    texts = df.select(*[_comparable(f).alias(f"c{i}") for i, f in enumerate(fields)])
    seen = texts.mapInArrow(_distinct_in_task(HELD_VALUES), "idx int, value string, rows long, missing long")
    # once by column and value, once by column
    once = seen.groupBy("idx", "value").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    counted = once.groupBy("idx").agg(F.count("value").alias("n_unique"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing"))
    names = F.create_map(*[x for i, f in enumerate(fields) for x in (F.lit(i), F.struct(F.lit(f.name).alias("name"), F.lit(_dtype(f)).alias("dtype")))])
    described = _all_columns(df, len(fields)).join(counted, "idx", "left").withColumn("f", names[F.col("idx")])
    return described.select(
        "idx",
        "f.name",
        "f.dtype",
        F.coalesce("n_unique", F.lit(0)).cast("bigint").alias("n_unique"),
        _share("missing", "rows").alias("missing_pct"),
    )


def _all_columns(df: DataFrame, count: int) -> DataFrame:
    return df.sparkSession.range(count).select(F.col("id").cast("int").alias("idx"))


def _dtype(field: T.StructField) -> str:
    return DTYPE_NAMES.get(field.dataType.simpleString(), "object")


def _share(missing: str, rows: str) -> Column:
    share = F.col(missing) / F.when(F.col(rows) > 0, F.col(rows))
    return F.round(F.coalesce(share, F.lit(0.0)), 6)


def profile_sketches(df: DataFrame, columns: list[str] | None = None, by: list[Column] | None = None) -> DataFrame:
    """``idx, name, dtype, rows, missing, sketch`` per column, and per group of ``by`` such as a file or a day.

    Sketches can be kept in a table and merged later, so that of a growing table only new files are read.
    """
    fields = [df.schema[c] for c in (columns or df.columns)]
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        text = _comparable(f)
        measures += [F.hll_sketch_agg(text, SKETCH_BITS).alias(f"s{i}"), F.count(text).alias(f"n{i}")]
    groups = [c.alias(f"_by{i}") for i, c in enumerate(by or [])]
    one_row = df.groupBy(*groups).agg(*measures) if groups else df.agg(*measures)
    entries = [
        F.struct(
            F.lit(i).alias("idx"),
            F.lit(f.name).alias("name"),
            F.lit(_dtype(f)).alias("dtype"),
            F.col("rows"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing"),
            F.col(f"s{i}").alias("sketch"),
        )
        for i, f in enumerate(fields)
    ]
    return one_row.select(*[f"_by{i}" for i in range(len(groups))], F.inline(F.array(*entries)))


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The column profile of everything that ``profile_sketches`` has seen, in one call or many."""
    merged = sketches.groupBy("idx", "name", "dtype").agg(
        F.hll_union_agg("sketch", F.lit(True)).alias("sketch"), F.sum("rows").alias("rows"), F.sum("missing").alias("missing")
    )
    unique = F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("bigint")
    return merged.select("idx", "name", "dtype", unique.alias("n_unique"), _share("missing", "rows").alias("missing_pct"))


def schema_card(
    df: DataFrame, label: str, columns: list[str], *, approximate: bool = False
) -> DataFrame:
    """Shape, labels, class shares and column profile as one JSON text (``card``).

    Labels must be integers, ``MAX_LABELS`` different ones at most; encode others first.
    """
    if not isinstance(df.schema[label].dataType, T.IntegralType):
        raise TypeError("labels must be integers, encode them first")
    many = F.raise_error(F.lit(f"more than {MAX_LABELS} labels"))
    some = class_priors(df, label).limit(MAX_LABELS + 1)
    priors = some.agg(
        F.when(F.count("label") > MAX_LABELS, many).otherwise(F.array_sort(F.collect_list("label"))).alias("labels"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), F.col("prior"))))
        ).alias("class_priors"),
    )
    profile = column_profile(df, columns, approximate=approximate).agg(
        F.array_sort(
            F.collect_list(
                F.struct("idx", "name", "dtype", F.col("n_unique").alias("unique"), "missing_pct")
            )
        ).alias("columns")
    )
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))  # unlabelled rows too, as in the shares
    return priors.withColumns({"columns": profile.scalar(), "n_rows": rows.scalar()}).select(
        F.to_json(
            F.struct(
                "n_rows",
                F.lit(len(columns)).alias("n_cols"),
                "labels",
                "class_priors",
                "columns",
            )
        ).alias("card")
    )


CARD_TYPE = (
    "struct<n_rows:bigint,n_cols:int,labels:array<bigint>,class_priors:map<string,double>,"
    "columns:array<struct<idx:int,name:string,dtype:string,unique:bigint,missing_pct:double>>>"
)


def rows_by_class(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """Row ids of each class in order, one row each: ``label, place, row_id``.

    A class of any size stays spread over many tasks, which one array per class would not allow.
    """
    named = df.select(F.col(label).alias("label"), F.col(row_id).alias("row_id"))
    return rank_by_value(named, ["label"], "row_id", name="place")


def constant_label(df: DataFrame, label: str) -> DataFrame:
    """One row: the only label of the table, or null when there are several."""
    return df.agg(
        F.when(F.min(label) == F.max(label), F.min(label)).alias("constant")
    )


def constant_label_predict(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Add ``pred``: the constant label of the training rows, null when a model is needed."""
    return test.withColumn("pred", constant_label(train, label).scalar())
