"""Scoring rows through a completion function given by the user.

``complete(prompts)`` takes a list of texts and returns as many replies.  It runs inside the tasks; tasks and open calls of a
task set how many calls are open at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabfold.functions import prompts
from tabfold.functions.text import features_json, features_text, parse_answer, variant_json, with_label
from tabfold.operators.neighbors import k_nearest, neighbor_lists
from tabfold.operators.profiling import label_space
from tabfold.operators.sampling import class_prototypes, context_sample
from tabfold.operators.vectors import vector_topk
from tabfold.plans.ledger import BATCH_ROWS, CONCURRENCY, Complete, ask_once
from tabfold.sources.vectors import scan_vector_table, sink_vector_table
from tabfold.workspace import new_folder, stage

Embed = Callable[[list[str]], list]


def score_prompts(
    df: DataFrame,
    complete: Complete,
    *,
    prompt: str = "prompt",
    batch_rows: int = BATCH_ROWS,
    concurrency: int = CONCURRENCY,
    parallelism: int | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """Add ``reply`` and ``error``, one of them null; every prompt that fails keeps its own error.

    A call holds at most ``batch_rows`` prompts and a task has ``concurrency`` calls open.  Replies are paid for: each
    distinct prompt is asked for once, also over lost tasks, and with a ``ledger`` over jobs; see ``ledger.ask_once``.
    """
    return ask_once(
        df, complete, prompt=prompt, batch_rows=batch_rows, concurrency=concurrency, parallelism=parallelism, ledger=ledger
    )


#: Texts, and characters of them, that an embedder gets at a time; a longer text comes alone.
EMBED_ROWS, EMBED_CHARS = 256, 1 << 20


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """Whole texts, in order, in lists of bounded size."""
    piece, size = [], 0
    for start in range(0, len(texts), EMBED_ROWS):
        for text in texts.slice(start, EMBED_ROWS).to_pylist():
            if piece and (len(piece) == EMBED_ROWS or size + len(text or "") > EMBED_CHARS):
                yield piece
                piece, size = [], 0
            piece.append(text)
            size += len(text or "")
    if piece:
        yield piece


def embed_text(df: DataFrame, text: str, embed: Embed, *, name: str = "embedding") -> DataFrame:
    """Add the embedding of a text column; ``embed`` gets whole texts, in lists of bounded size."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.float32())
        for batch in batches:
            parts = [pa.array([], kind)]
            for piece in _pieces(batch):
                found = [None if v is None else np.asarray(v, np.float32) for v in embed(piece)]
                parts.append(pa.array(found, kind))
            yield pa.concat_arrays(parts)

    return df.withColumn(name, run(F.col(text)))


def _shown(df: DataFrame, label: Column | None = None, row: Column | None = None, features: Column | None = None) -> Column:
    """A row as prompts show it: by its own names and types where it has a VARIANT column ``row``, else by position."""
    if "row" in df.columns:
        return variant_json(F.col("row") if row is None else row, label=label)
    return features_json(F.col("features") if features is None else features, label=label)


def _schema_json(df: DataFrame) -> Column:
    """Names of the features: those of the typed row, else their positions."""
    if "row" in df.columns:
        return F.to_json(F.json_object_keys(F.to_json("row")))
    return F.to_json(F.transform(F.sequence(F.lit(0), F.size("features") - 1), lambda i: i.cast("string")))


def zero_shot_prompts(train: DataFrame, test: DataFrame, *, context_rows: int = 0) -> DataFrame:
    """``row_id, labels, prompt`` for the test rows."""
    context = None
    rows = test.withColumn("labels", label_space(train, "label").scalar())
    if context_rows:
        sample = context_sample(train, "row_id", context_rows).agg(
            F.array_sort(F.collect_list(F.struct("row_id", _shown(train).alias("j")))).alias("s")
        )
        shown = sample.select(
            F.concat(F.lit("["), F.array_join(F.transform("s", lambda e: e["j"]), ","), F.lit("]")).alias("c")
        )
        rows = rows.withColumn("context", shown.scalar())
        context = F.col("context")
    prompt = prompts.prompt_zero_shot(F.to_json("labels"), _schema_json(rows), _shown(test), context)
    return rows.select("row_id", "labels", prompt.alias("prompt"))


def few_shot_examples(train: DataFrame, *, per_class: int = 2, max_examples: int = 20) -> DataFrame:
    """One row with the prototypes as a JSON list, at most ``max_examples`` long."""
    picked = class_prototypes(train, "label", "row_id", per_class=per_class, max_examples=max_examples)
    entry = F.struct("position", _shown(train, F.col("label")).alias("j"))
    lists = picked.agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return lists.select(
        F.concat(F.lit("["), F.array_join(F.transform("s", lambda e: e["j"]), ","), F.lit("]")).alias("examples")
    )


def few_shot_prompts(train: DataFrame, test: DataFrame, *, per_class: int = 2, max_examples: int = 20) -> DataFrame:
    examples = few_shot_examples(train, per_class=per_class, max_examples=max_examples)
    rows = test.withColumn("labels", label_space(train, "label").scalar()).withColumn(
        "examples", examples.scalar()
    )
    prompt = prompts.prompt_few_shot(F.to_json("labels"), F.col("examples"), _shown(test))
    return rows.select("row_id", "labels", prompt.alias("prompt"))


def hybrid_prompts(train: DataFrame, test: DataFrame, *, k: int = 3, group: str | None = None) -> DataFrame:
    """Prompts that show each test row its k nearest training rows."""
    typed = "row" in train.columns
    # a typed row travels as its JSON text beside the label; an untyped one is its features
    carried = F.struct("label", F.to_json("row").alias("text")) if typed else F.col("label")
    stored = train.withColumn("_carried", carried)
    found = k_nearest(
        test, stored, k, test_id="row_id", train_id="row_id", payload="_carried", group=group, with_features=not typed
    )
    columns = ["payload"] if typed else ["train_features", "payload"]
    lists = neighbor_lists(found, columns)
    if typed:
        one = lambda n: with_label(n["payload"]["text"], n["payload"]["label"])
    else:
        one = lambda n: features_json(n["train_features"], label=n["payload"])
    shown = F.concat(F.lit("["), F.array_join(F.transform("neighbors", one), ","), F.lit("]"))
    own = ["row"] if typed else []
    asked = test.select("row_id", "features", *own).join(lists.withColumnRenamed("test_id", "row_id"), "row_id")
    return asked.select("row_id", prompts.prompt_retrieval(shown, _shown(asked)).alias("prompt"))


def build_vector_table(
    train: DataFrame, embed: Embed, path: str, *, document: Column | None = None, group: str | None = None
) -> DataFrame:
    """Replace the table of embedded training rows at ``path`` and return it; ``group`` is an integer column to keep."""
    text = features_text("features", "label") if document is None else document
    own = [group] if group else []
    rows = train.select(F.col("row_id").cast("string").alias("id"), text.alias("document"), *own)
    sink_vector_table(embed_text(rows, "document", embed), path, group)
    return scan_vector_table(train.sparkSession, path, group)


def rag_prompts(stored: DataFrame, test: DataFrame, embed: Embed, *, k: int = 3, group: str | None = None) -> DataFrame:
    """Prompts that show each test row the k documents nearest to its text, by one embedder for both.

    Rows and documents of equal ``group`` do not meet.
    """
    own = [group] if group else []
    queries = test.select("row_id", features_text("features").alias("query"), *own)
    queries = stage(embed_text(queries, "query", embed), "queries")
    found = vector_topk(
        queries, stored, k, query_id="row_id", stored_id="id", embedding="embedding", payload="document", group=group
    )
    lists = found.groupBy("test_id").agg(F.array_sort(F.collect_list(F.struct("rank", "payload"))).alias("d"))
    shown = F.array_join(F.transform("d", lambda e: e["payload"]), "\n")
    asked = queries.select("row_id", "query").join(lists.withColumnRenamed("test_id", "row_id"), "row_id")
    return asked.select("row_id", prompts.prompt_retrieval(shown, F.col("query")).alias("prompt"))


def classify_prompts(prompted: DataFrame, complete: Complete, *, checked: bool = True, calls: dict | None = None) -> DataFrame:
    """``row_id, pred`` of prompts, be they of one split or of many: all are asked in one job.

    ``checked`` answers must be among the row's ``labels``; ``calls`` are settings of ``score_prompts``.
    """
    labels = F.col("labels") if checked else None
    replied = score_prompts(prompted, complete, **(calls or {}))
    return parse_answer(replied, "reply", labels=labels).select("row_id", "pred")


def classify_zero_shot(
    train: DataFrame, test: DataFrame, complete: Complete, *, context_rows: int = 0, calls: dict | None = None
) -> DataFrame:
    """``row_id, pred``; answers outside the label space count as -1."""
    return classify_prompts(zero_shot_prompts(train, test, context_rows=context_rows), complete, calls=calls)


def classify_few_shot(
    train: DataFrame,
    test: DataFrame,
    complete: Complete,
    *,
    per_class: int = 2,
    max_examples: int = 20,
    calls: dict | None = None,
) -> DataFrame:
    prompted = few_shot_prompts(train, test, per_class=per_class, max_examples=max_examples)
    return classify_prompts(prompted, complete, calls=calls)


def classify_hybrid(
    train: DataFrame, test: DataFrame, complete: Complete, *, k: int = 3, group: str | None = None, calls: dict | None = None
) -> DataFrame:
    return classify_prompts(hybrid_prompts(train, test, k=k, group=group), complete, checked=False, calls=calls)


def classify_rag(
    train: DataFrame,
    test: DataFrame,
    complete: Complete,
    embed: Embed,
    *,
    k: int = 3,
    group: str | None = None,
    calls: dict | None = None,
) -> DataFrame:
    stored = build_vector_table(train, embed, new_folder(train.sparkSession, "vectors"), group=group)
    prompted = rag_prompts(stored, test, embed, k=k, group=group)
    return classify_prompts(prompted, complete, checked=False, calls=calls)
