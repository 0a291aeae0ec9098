"""Rows as text and JSON; JSON found in replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

NO_ANSWER = -1


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_text(value: Column, kind: T.DataType) -> Column:
    """Text of a value as a scripting language prints it: ``1.0``, ``12345678.5``, ``1e-05``, ``nan``."""
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(value.cast("string"), F.lit("nan"))
    text = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(
        F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    digits = F.concat(F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    power_text = F.concat(F.when(power < 0, "-").otherwise("+"), digits)
    return (
        F.when(value.isNull() | F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), power_text))
    )


def row_text(df: DataFrame, columns: list[str], label: str | None = None) -> Column:
    """``Features: v1, v2`` and, for a stored row, ``. Label: y``."""
    parts = [number_text(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    text = F.concat(F.lit("Features: "), F.concat_ws(", ", *parts))
    if label is None:
        return text
    return F.concat(text, F.lit(". Label: "), F.col(label).cast("string"))


def features_text(features: str, label: str | None = None) -> Column:
    """The same for a feature array."""
    parts = F.transform(features, lambda x: number_text(x.cast("double"), T.DoubleType()))
    text = F.concat(F.lit("Features: "), F.array_join(parts, ", "))
    if label is None:
        return text
    return F.concat(text, F.lit(". Label: "), F.col(label).cast("string"))


def row_json(columns: list[str], *extra: Column, as_floats: bool = False) -> Column:
    """One JSON object keyed by column, gaps kept as null.

    ``as_floats`` gives all columns as reals, which is how example rows appear; a row to classify
    keeps its own types.
    """
    fields = [F.col(f"`{c}`").cast("double").alias(c) if as_floats else F.col(f"`{c}`") for c in columns]
    return F.to_json(F.struct(*fields, *extra), {"ignoreNullFields": "false"})


def variant_row(columns: list[str]) -> Column:
    """The columns as one VARIANT object, each with its own name and type; gaps are null.

    Objects of this type keep their keys in alphabetical order.
    """
    return F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in columns]))


def with_label(text: Column, label: Column) -> Column:
    """A JSON object with the label as its last entry."""
    entry = F.concat(F.lit('"label":'), label.cast("string"), F.lit("}"))
    inside = F.substring(text, F.lit(1), F.length(text) - 1)
    return F.when(text == "{}", F.concat(F.lit("{"), entry)).otherwise(F.concat(inside, F.lit(","), entry))


def variant_json(row: Column, *, label: Column | None = None) -> Column:
    """JSON object of a VARIANT row, with the label as its last entry."""
    text = F.to_json(row)
    return text if label is None else with_label(text, label)


def features_json(features: str | Column, *, label: Column | None = None) -> Column:
    """JSON object of a feature array, keyed by position."""
    features = F.col(features) if isinstance(features, str) else features
    keyed = F.transform(
        features,
        lambda x, i: F.concat(
            F.lit('"'), i.cast("string"), F.lit('":'),
            F.when(F.isnan(x) | x.isNull(), "null").otherwise(x.cast("string")),
        ),
    )
    body = F.array_join(keyed, ",")
    if label is not None:
        body = F.concat_ws(",", body, F.concat(F.lit('"label":'), label.cast("string")))
    return F.concat(F.lit("{"), body, F.lit("}"))


def extract_first_json(text: Column) -> Column:
    """From the first ``{`` to the next ``}``; the stripped text when there is no such pair.

    Found by position, so a long reply is read once.
    """
    begin = F.position(F.lit("{"), text)
    end = F.when(begin > 0, F.position(F.lit("}"), text, begin)).otherwise(0)
    return F.when(end > 0, F.substring(text, begin, end - begin + 1)).otherwise(
        F.regexp_replace(text, r"^\s+|\s+$", "")
    )


def parse_answer(replies: DataFrame, reply: str, *, labels: Column | None = None, name: str = "pred") -> DataFrame:
    """Add the class number found in a reply, -1 when it cannot be read.

    Needs a whole ``classification`` (number, numeric text or boolean) and a text ``reasoning``.  With
    ``labels`` the number must be one of them.
    """
    steps = replies.withColumn("_json", extract_first_json(F.col(reply))).withColumn(
        "_answer", F.try_parse_json("_json")
    )
    steps = steps.select(
        *replies.columns,
        F.trim(F.try_variant_get("_answer", "$.classification", "string")).alias("_given"),
        F.schema_of_variant(F.try_variant_get("_answer", "$.classification", "variant")).alias("_kind"),
        F.schema_of_variant(F.try_variant_get("_answer", "$.reasoning", "variant")).alias("_reason"),
    )
    given = F.col("_given")
    # a boolean counts, the words true and false as text do not
    number = F.when(
        F.col("_kind") == "BOOLEAN", F.when(given == "true", 1).otherwise(0)
    ).when(given.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.substring_index(given, ".", 1).try_cast("int"))
    steps = steps.withColumn("_number", F.when(F.col("_reason") == "STRING", number))
    result = F.col("_number")
    if labels is not None:
        result = F.when(F.array_contains(labels, result), result)
    return steps.withColumn(name, F.coalesce(result, F.lit(NO_ANSWER))).select(
        *[c for c in replies.columns if c != name], name
    )


def extract_all_json(text: Column) -> Column:
    """All outermost ``{...}`` by counting braces; a stray ``}`` is ignored, an unclosed tail dropped.

    The text is cut at its braces only, and spans are carried instead of strings.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[{}]|[^{}]+"), F.lit(0))
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("begin"),
        F.lit(1).alias("at"),
        F.array().cast("array<struct<begin:int,size:int>>").alias("spans"),
    )

    def step(s: Column, token: Column) -> Column:
        opens, closes = token == "{", token == "}"
        span = F.struct(s["begin"].alias("begin"), (s["at"] - s["begin"] + 1).alias("size"))
        return F.struct(
            F.when(opens, s["depth"] + 1)
            .when(closes & (s["depth"] > 0), s["depth"] - 1)
            .otherwise(s["depth"])
            .alias("depth"),
            F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["begin"]).alias("begin"),
            (s["at"] + F.length(token)).alias("at"),
            F.when(closes & (s["depth"] == 1), F.concat(s["spans"], F.array(span)))
            .otherwise(s["spans"])
            .alias("spans"),
        )

    spans = F.aggregate(tokens, start, step, lambda s: s["spans"])
    return F.transform(spans, lambda p: F.substring(text, p["begin"], p["size"]))


# Keys that mark an echo of the dataset's metadata.
METADATA_KEYS = ["target_column_index", "num_features", "num_samples", "feature_indices"]


def is_metadata_echo(json: Column) -> Column:
    return F.coalesce(
        F.arrays_overlap(F.json_object_keys(json), F.array(*[F.lit(k) for k in METADATA_KEYS])), F.lit(False)
    )


def truncate_text(text: Column, size: int, mark: str = "") -> Column:
    """First ``size`` characters, with a mark when something was cut off.

    For log lines and short notes; nothing is computed from the cut text.
    """
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def selection_summary(model: Column, hp: Column, leaderboard: Column | None = None) -> Column:
    """``model=..., hp={...}`` and the leaderboard behind it."""
    text = F.concat(F.lit("model="), model, F.lit(", hp="), hp)
    if leaderboard is None:
        return text
    return F.concat(text, F.lit(" | leaderboard="), leaderboard)


def summary_model(summary: Column) -> Column:
    return F.regexp_replace(F.split(summary, ", hp=", 2)[0], "^model=", "")


def summary_hp(summary: Column) -> Column:
    """The hyperparameters alone, without the leaderboard that follows them."""
    return F.regexp_replace(F.get(F.split(summary, ", hp=", 2), F.lit(1)), r" \| leaderboard=.*$", "")
