"""Delimited text with the missing-value words and the type inference of a data-frame reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabfold.sources.lines import number_rows, with_locator

# Texts read as a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Texts read as a boolean.
TRUE_WORDS = ["True", "TRUE", "true"]
FALSE_WORDS = ["False", "FALSE", "false"]


def _known(column: str) -> Column:
    value = F.col(f"`{column}`")
    return F.when(~F.trim(value).isin(MISSING_WORDS), value)


def _whole(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("bigint"))


def _real(value: Column) -> Column:
    # a trailing d or f is a number to the cast but not to the reader
    text = F.trim(value)
    return F.when(~text.rlike("[dDfF]$") | F.lower(text).rlike("inf$"), text.try_cast("double"))


def infer_types(raw: DataFrame, columns: list[str]) -> dict[str, T.DataType]:
    """Type of each text column, found in one pass: whole numbers, reals, booleans or text.

    Whole numbers with gaps become reals; a column without any value is real too.
    """
    tests = []
    for i, c in enumerate(columns):
        value = _known(c)
        tests += [
            F.coalesce(F.bool_and(_whole(value).isNotNull() | value.isNull()), F.lit(True)).alias(f"w{i}"),
            F.coalesce(F.bool_and(_real(value).isNotNull() | value.isNull()), F.lit(True)).alias(f"r{i}"),
            F.coalesce(
                F.bool_and(value.isin(TRUE_WORDS + FALSE_WORDS) | value.isNull()), F.lit(True)
            ).alias(f"b{i}"),
            F.coalesce(F.bool_or(value.isNull()), F.lit(True)).alias(f"m{i}"),
        ]
    seen = raw.agg(*tests).first()
    types: dict[str, T.DataType] = {}
    for i, c in enumerate(columns):
        if seen[f"r{i}"]:
            whole = seen[f"w{i}"] and not seen[f"m{i}"]
            types[c] = T.LongType() if whole else T.DoubleType()
        else:
            types[c] = T.BooleanType() if seen[f"b{i}"] else T.StringType()
    return types


def _typed(column: str, kind: T.DataType) -> Column:
    value = _known(column)
    if isinstance(kind, T.LongType):
        return _whole(value).alias(column)
    if isinstance(kind, T.BooleanType):
        return value.isin(TRUE_WORDS).alias(column)
    if isinstance(kind, T.StringType):
        return value.alias(column)
    real = _real(value)
    return F.when(~F.isnan(real), real).cast(kind).alias(column)


def _scan(
    spark: SparkSession,
    path: str,
    sep: str,
    header: bool,
    types: dict[str, T.DataType] | None,
    row_id: str | None,
) -> DataFrame:
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False, quote='"', escape='"')
    columns = list(raw.columns)
    if not header:
        columns = [str(i) for i in range(len(columns))]
    if row_id:
        located = with_locator(raw, raw.columns).toDF(*columns, "_file", "_block", "_seq")
        raw = number_rows(located, row_id)
    else:
        raw = raw.toDF(*columns)
    types = types or infer_types(raw, columns)
    return raw.select(*([row_id] if row_id else []), *[_typed(c, types[c]) for c in columns])


def scan_csv_positional(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    types: dict[str, T.DataType] | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Headerless file, columns named ``0``, ``1``, ...; ``row_id`` asks for a position column.

    Giving ``types`` saves the pass that infers them.
    """
    return _scan(spark, path, sep, False, types, row_id)


def scan_csv_header(
    spark: SparkSession,
    path: str,
    *,
    sep: str = ",",
    types: dict[str, T.DataType] | None = None,
    row_id: str | None = None,
) -> DataFrame:
    return _scan(spark, path, sep, True, types, row_id)


def _as_text(df: DataFrame) -> DataFrame:
    """Booleans in the spelling of the reader; everything else as Spark writes it."""
    return df.select(
        *[
            F.initcap(F.col(f"`{f.name}`").cast("string")).alias(f.name)
            if isinstance(f.dataType, T.BooleanType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def sink_csv_positional(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Write without a header line."""
    _as_text(df).write.mode(mode).csv(path, header=False, escape='"', emptyValue="")


def sink_csv_header(df: DataFrame, path: str, *, sep: str = ",", mode: str = "errorifexists") -> None:
    _as_text(df).write.mode(mode).csv(path, header=True, sep=sep, escape='"', emptyValue="")
