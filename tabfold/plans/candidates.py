"""Model candidates: read from replies, cleaned, completed, ranked."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabfold.functions import prompts
from tabfold.functions.numbers import clamp_float, clamp_int
from tabfold.functions.text import METADATA_KEYS, extract_all_json, once

# Models, and per hyperparameter its kind, bounds and default.
MODELS = ["lr", "rf", "hgb", "knn"]
BOUNDS = {
    "lr": {"C": ("float", 1e-3, 1e3, 1.0), "class_weight": ("word", ["balanced"], None, None)},
    "rf": {
        "max_depth": ("int", 1, 100, None),
        "min_samples_leaf": ("int", 1, 50, 1),
        "min_samples_split": ("int", 2, 50, 2),
        "n_estimators": ("int", 50, 2000, 600),
    },
    "hgb": {
        "l2_regularization": ("float", 0.0, 10.0, 0.0),
        "learning_rate": ("float", 1e-4, 1.0, 0.06),
        "max_depth": ("int", 1, 100, None),
        "max_iter": ("int", 50, 2000, 400),
    },
    "knn": {
        "n_neighbors": ("int", 3, 100, 31),
        "weights": ("word", ["uniform", "distance"], None, "distance"),
    },
}

# Candidates used when a reply gives none, baselines added always.
DEFAULTS = [
    ("hgb", '{"learning_rate":0.06,"max_iter":600}', "robust default"),
    ("rf", '{"n_estimators":600}', "deeper rf"),
    ("rf", '{"n_estimators":1000,"max_depth":20}', "more trees"),
    ("lr", '{"C":1.0}', "linear baseline"),
    ("knn", '{"n_neighbors":31,"weights":"distance"}', "distance votes"),
]
BASELINES = [
    ("rf", '{"n_estimators":600}', "deeper rf"),
    ("rf", '{"n_estimators":1000,"max_depth":20}', "more trees"),
    ("hgb", '{"learning_rate":0.06,"max_iter":600}', "longer hgb"),
    ("hgb", '{"learning_rate":0.1,"max_iter":400,"max_depth":16,"l2_regularization":1.0}', "faster hgb"),
]
FALLBACK = ("hgb", '{"learning_rate":0.06,"max_iter":600}')
BALANCED_FROM = 0.7
BASELINE_ORD = 1_000_000  # proposals come before baselines

_CANDIDATES = "array<struct<model:string,hp:string,why:string>>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("ABSENT"))


def _part(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _text(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "string")


def _candidate(item: Column, reason: str, cut: bool) -> Column:
    hp = F.coalesce(F.to_json(_part(item, "hyperparameters")), F.lit("{}"))
    why = F.coalesce(_text(item, reason), F.lit(""))
    why = F.substring(why, 1, 64) if cut else why
    return F.struct(_text(item, "model").alias("model"), hp.alias("hp"), why.alias("why"))


def _usable(item: Column, strict_why: bool) -> Column:
    """A known model, an object of hyperparameters or none, a text as reason or none."""
    model = (_kind(_part(item, "model")) == "STRING") & F.coalesce(_text(item, "model").isin(MODELS), F.lit(False))
    hp = _kind(_part(item, "hyperparameters"))
    ok = model & (hp.startswith("OBJECT") | (hp == "ABSENT"))
    if strict_why:
        ok = ok & _kind(_part(item, "why")).isin("STRING", "ABSENT")
    return ok


def _read(block: Column) -> Column:
    """What one JSON value offers: ``state`` 0 nothing, 1 candidates, 2 an error that voids the reply."""

    def with_model(items: Column) -> Column:
        return F.filter(
            items, lambda c: _kind(c).startswith("OBJECT") & (_kind(_part(c, "model")) != "ABSENT")
        )

    def from_list(items: Column, named: bool) -> Column:
        """``named``: the list stands under ``candidates``, where reasons are checked and kept whole."""
        return once(
            with_model(items),
            lambda known: F.when(
                F.size(known) > 0,
                F.struct(
                    F.when(F.exists(known, lambda c: ~_usable(c, named)), 2).otherwise(1).alias("state"),
                    F.transform(known, lambda c: _candidate(c, "why", not named)).alias("found"),
                ),
            ),
        )

    listed = F.when(
        _kind(_part(block, "candidates")).startswith("ARRAY"),
        from_list(F.try_variant_get(block, "$.candidates", "array<variant>"), True),
    )
    single = F.when(
        (_kind(_part(block, "model")) != "ABSENT") & (_kind(_part(block, "hyperparameters")) != "ABSENT"),
        F.struct(
            F.when(_usable(block, False), 1).otherwise(2).alias("state"),
            F.array(_candidate(block, "reasoning", True)).alias("found"),
        ),
    )
    bare = F.when(_kind(block).startswith("ARRAY"), from_list(block.try_cast("array<variant>"), False))
    nothing = F.struct(F.lit(0).alias("state"), F.array().cast(_CANDIDATES).alias("found"))
    return F.coalesce(listed, single, bare, nothing)


def _echo(block: Column) -> Column:
    """An object with one of the metadata keys."""
    keys = [_kind(_part(block, k)) != "ABSENT" for k in METADATA_KEYS]
    return F.coalesce(keys[0] | keys[1] | keys[2] | keys[3], F.lit(False))


def read_candidates(replies: DataFrame, reply: str, name: str = "found") -> DataFrame:
    """Add the array of ``model, hp, why`` proposed by a reply, null when it gives no valid set.

    The first JSON object that offers something decides; echoes of the metadata are passed over.  All
    work stays inside the row; the steps are columns of their own so that none is computed twice.
    """
    parsed = F.filter(
        F.transform("_blocks", lambda b: F.try_parse_json(b)), lambda v: v.isNotNull() & ~_echo(v)
    )
    whole = F.when(F.col("_whole").isNotNull() & ~_echo(F.col("_whole")), F.array("_whole"))
    steps = replies.withColumn("_blocks", extract_all_json(F.col(reply)))
    steps = steps.withColumn("_parsed", parsed).withColumn(
        "_whole", F.when(F.size("_parsed") == 0, F.try_parse_json(F.col(reply)))
    )
    steps = steps.withColumn("_values", F.when(F.size("_parsed") > 0, F.col("_parsed")).otherwise(whole))
    offers = F.filter(F.transform("_values", _read), lambda o: o["state"] > 0)
    steps = steps.withColumn("_first", F.get(offers, F.lit(0)))
    return steps.withColumn(name, F.when(F.col("_first.state") == 1, F.col("_first.found"))).select(
        *replies.columns, name
    )


def _literal(rows: list[tuple[str, str, str]]) -> Column:
    return F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(h).alias("hp"), F.lit(w).alias("why")) for m, h, w in rows]
    )


def parse_candidates(replies: DataFrame, reply: str, *, defaults: bool = False) -> DataFrame:
    """One row per proposed candidate: the other columns, ``ord, model, hp, why``.

    With ``defaults`` a reply without a valid set yields the safe default candidates.
    """
    read = read_candidates(replies, reply, "_found")
    found = F.coalesce("_found", _literal(DEFAULTS)) if defaults else F.col("_found")
    rest = [c for c in replies.columns if c != reply]
    # the outer form: the plain one tests the array first, and the optimizer would push that test,
    # with all the reading in it, below the steps above
    exploded = read.select(*rest, F.posexplode_outer(found).alias("ord", "c")).filter("ord is not null")
    return exploded.select(*rest, "ord", "c.*")


def _int_text(given: Column) -> Column:
    """Text that ``clamp_int`` may read: numbers lose their fraction, booleans are 1 and 0."""
    text, kind = given["text"], given["kind"]
    return (
        F.when(kind.isin("BIGINT", "STRING"), text)
        .when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0"))
        .when(
            kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"),
            F.substring_index(text.try_cast("decimal(38,6)").cast("string"), ".", 1),
        )
    )


def _float_text(given: Column) -> Column:
    text, kind = given["text"], given["kind"]
    return (
        F.when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("0"))
        .when(kind == "STRING", F.when(~text.rlike("[0-9.][dDfF]$"), text))
        .when(~kind.rlike("^(OBJECT|ARRAY)"), text)
    )


def _bounded(given: Column, spec: tuple) -> Column:
    kind, low, high, default = spec
    if kind == "word":
        fits = (given["kind"] == "STRING") & given["text"].isin(low)
        return F.when(fits, given["text"]).otherwise(F.lit(default).cast("string"))
    if kind == "float":
        return clamp_float(_float_text(given), low, high, default)
    return clamp_int(_int_text(given), low, high, default)


def sanitize_candidates(candidates: DataFrame, n_rows: str) -> DataFrame:
    """``hp`` as JSON with sorted keys: unknown keys gone, values in bounds, gaps filled.

    Projections only: the few bounds are constants of the expressions.
    """
    keys = {k: spec for specs in BOUNDS.values() for k, spec in specs.items()}
    steps = candidates.withColumn("_given", F.try_parse_json("hp"))

    def read(key: str) -> Column:
        # only the models that know the key look for it
        owners = [m for m, specs in BOUNDS.items() if key in specs]
        given = F.struct(_kind(_part(F.col("_given"), key)).alias("kind"), _text(F.col("_given"), key).alias("text"))
        return F.when(F.col("model").isin(owners), given).alias(f"_{key}")

    steps = steps.select(*candidates.columns, *[read(k) for k in keys])
    root = F.sqrt(F.greatest(F.col(n_rows), F.lit(1)))
    steps = steps.select(
        *candidates.columns,
        *[_bounded(F.col(f"_{k}"), spec).alias(f"_{k}") for k, spec in keys.items()],
        F.greatest(F.lit(3), F.least(F.lit(100), (root * 3).cast("int"))).alias("_largest_k"),
    )
    k = F.col("_n_neighbors")
    steps = steps.withColumn(
        "_n_neighbors", F.when(k.between(3, F.col("_largest_k")), k).otherwise(F.least(F.lit(31), "_largest_k"))
    )
    text = None
    for name, specs in BOUNDS.items():
        fields = F.struct(*[F.col(f"_{key}").alias(key) for key in specs])
        shown = F.to_json(fields, {"ignoreNullFields": "false"})
        text = F.when(F.col("model") == name, shown) if text is None else text.when(F.col("model") == name, shown)
    return steps.withColumn("hp", text.otherwise(F.lit("{}"))).select(*candidates.columns)


def baselines(groups: DataFrame, n_rows: str, max_prior: str) -> DataFrame:
    """The fixed baselines plus one LR and one KNN fitted to the table's shape, for every row given."""
    lr = F.struct(
        F.lit("lr").alias("model"),
        F.when(F.col(max_prior) >= BALANCED_FROM, '{"C":1.0,"class_weight":"balanced"}')
        .otherwise('{"C":1.0,"class_weight":null}')
        .alias("hp"),
        F.lit("linear check").alias("why"),
    )
    k = F.least(
        F.lit(51), F.greatest(F.lit(5), (F.sqrt(F.greatest(F.col(n_rows), F.lit(1))) * 2).cast("int"))
    )
    knn = F.struct(
        F.lit("knn").alias("model"),
        F.concat(F.lit('{"n_neighbors":'), k.cast("string"), F.lit(',"weights":"distance"}')).alias("hp"),
        F.lit("scale k").alias("why"),
    )
    every = F.concat(_literal(BASELINES), F.array(lr, knn))
    rows = groups.select("*", F.posexplode(every).alias("_at", "c"))
    return rows.select(*groups.columns, (F.col("_at") + BASELINE_ORD).alias("ord"), "c.*")


def candidate_pool(proposed: DataFrame, groups: DataFrame, by: list[str], n_rows: str, max_prior: str) -> DataFrame:
    """Proposals and baselines of each group, sanitized, the first of equal ones kept."""
    facts = groups.select(*by, n_rows, max_prior)
    own = proposed.select(*by, "ord", "model", "hp", "why").join(facts, by)
    pool = sanitize_candidates(own.unionByName(baselines(facts, n_rows, max_prior)), n_rows)
    first = Window.partitionBy(*by, "model", "hp").orderBy("ord")
    return (
        pool.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .select(*by, "ord", "model", "hp", "why")
    )


def _catalog() -> str:
    described = {}
    for model, keys in BOUNDS.items():
        described[model] = {}
        for key, (kind, low, high, default) in keys.items():
            if kind == "word":
                described[model][key] = {"one of": low + ([] if default else [None])}
            else:
                described[model][key] = {"kind": kind, "from": low, "to": high, "default": default}
    return json.dumps(described)


def prompt_candidates(card: Column, rows: Column, metadata: Column, template: str = prompts.PROPOSAL) -> Column:
    """Request for candidates from a schema card, the first rows and the metadata."""
    return prompts.fill(
        template,
        forbidden=json.dumps(METADATA_KEYS),
        models=json.dumps(MODELS),
        catalog=_catalog(),
        card=card,
        rows=rows,
        metadata=F.coalesce(metadata, F.lit("null")),
    )


def prompt_candidates_minimal(template: str = prompts.PROPOSAL_MINIMAL) -> Column:
    return prompts.fill(
        template, forbidden=json.dumps(METADATA_KEYS), models=json.dumps(MODELS), catalog=_catalog()
    )
