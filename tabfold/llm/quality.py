"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The queries count the code points of all trusted documents, and score by joins, see ``ngrams``.  ``Model``
is the same model for a short sample: 64 character classes (upper-case letters one, digits one, the most
frequent other signs one each, the rest two) and a table of at most 64**4 cells on the driver.

A document is rejected when its mean negative log-likelihood is above the quantile that trusted documents of
its language reach, with an allowance for the noise of short texts.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabfold.llm import ngrams
from tabfold.llm.arrays import short_batches, slices, text_list
from tabfold.llm.ngrams import discounts as _discounts
from tabfold.workspace import stage

ORDER = 4
BITS = 6
SYMBOLS = 1 << BITS
START, UPPER, DIGIT, LETTER, SIGN, FIRST_FREE = range(6)

#: Languages with fewer trusted documents use the quantile of all.
FEWEST_TRUSTED = 50
LANGUAGES = 512
#: Quantile of trusted documents that passes, and the allowance in nats, divided by sqrt(code points).
QUANTILE = 0.99
ALLOWANCE = 1.5
#: Nats a document may lie above that quantile.
SLACK = 0.05


def _plain_kind(point: int) -> int:
    kind = unicodedata.category(chr(point))
    if kind in ("Lu", "Lt"):
        return UPPER
    if kind[0] == "N":
        return DIGIT
    return LETTER if kind[0] == "L" else SIGN


def symbol_table(alphabet: tuple[int, ...]) -> np.ndarray:
    table = np.fromiter((_plain_kind(p) for p in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    for i, point in enumerate(alphabet[: SYMBOLS - FIRST_FREE]):
        table[point] = FIRST_FREE + i
    return table


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def codes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram code that ends at every code point, and the text lengths; texts start after START signs."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = ORDER - 1
    total = int(lengths.sum())
    symbols = np.full(total + pad * len(texts), START, np.uint32)
    starts = np.cumsum(lengths + pad) - lengths
    place = np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    symbols[place] = table[_points(texts)]
    code = symbols.copy()
    for back in range(1, ORDER):
        code[back:] |= symbols[:-back] << np.uint32(BITS * back)
    return code[place], lengths


@dataclass(frozen=True)
class Model:
    """Discounted shares of seen n-grams and back-off weights of contexts, by order."""

    alphabet: tuple[int, ...]
    grams: tuple[tuple[np.ndarray, np.ndarray], ...]
    contexts: tuple[tuple[np.ndarray, np.ndarray], ...]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def log_table(self) -> np.ndarray:
        """log p of every 4-gram code, interpolated down to the uniform distribution."""
        lower = np.full(1, 1.0 / SYMBOLS, np.float32)
        for order in range(1, ORDER + 1):
            share = np.zeros(1 << (BITS * order), np.float32)
            share[self.grams[order - 1][0]] = self.grams[order - 1][1]
            weight = np.ones(1 << (BITS * (order - 1)), np.float32)
            weight[self.contexts[order - 1][0]] = self.contexts[order - 1][1]
            share = share.reshape(-1, SYMBOLS)
            if order == 1:
                share += weight[:, None] * lower
            else:
                # the shorter context drops the oldest sign
                share.reshape(SYMBOLS, -1, SYMBOLS)[:] += weight.reshape(SYMBOLS, -1)[:, :, None] * lower.reshape(-1, SYMBOLS)
            lower = share.reshape(-1)
        return np.log(lower)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids labelled of good quality and not toxic, in every label they have; null labels are no trust."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    return marks.agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("id")


def fit(sample: DataFrame, text_col: str = "text") -> Model:
    """Counts of the sample's texts, joined into a model.  Null and empty texts add nothing."""
    short_batches(sample.sparkSession)
    texts = sample.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            points, counts = np.unique(_points(text_list(batch.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(points.astype(np.int32)), pa.array(counts)], ["point", "n"])

    found = texts.mapInArrow(count_points, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))
    ranked = found.orderBy(F.desc("n"), "point").limit(4 * SYMBOLS).collect()
    plain = [r["point"] for r in ranked if _plain_kind(r["point"]) in (LETTER, SIGN)]
    alphabet = tuple(plain[: SYMBOLS - FIRST_FREE])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(alphabet)
        for batch in slices(batches, "text"):
            seen, counts = np.unique(codes(text_list(batch.column("text")), table)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts)], ["gram", "n"])

    grams = texts.mapInArrow(count_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    tables, weights = [], []
    for order in range(ORDER, 0, -1):
        grams = stage(grams, f"grams{order}")
        of = grams.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
        discount = _discounts([of[f"n{k}"] for k in range(1, 5)])
        cut = F.when(F.col("n") == 1, discount[0]).when(F.col("n") == 2, discount[1]).otherwise(discount[2])
        counted = grams.withColumns({"context": F.shiftright("gram", BITS), "cut": cut})
        contexts = counted.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        shares = counted.join(contexts, "context").select(
            "gram", (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total")).alias("share")
        )
        # at most 64**order cells
        share = shares.toPandas()
        weight = contexts.select("context", (F.col("freed") / F.col("total")).alias("weight")).toPandas()
        tables.append((share["gram"].to_numpy(np.int64), share["share"].to_numpy(np.float32)))
        weights.append((weight["context"].to_numpy(np.int64), weight["weight"].to_numpy(np.float32)))
        shorter = F.col("gram").bitwiseAND((1 << (BITS * (order - 1))) - 1)
        grams = grams.groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))
    return Model(alphabet, tuple(reversed(tables)), tuple(reversed(weights)))


_READY: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _ready(model: Model) -> tuple[np.ndarray, np.ndarray]:
    if model.name not in _READY:
        _READY.clear()
        _READY[model.name] = (symbol_table(model.alphabet), model.log_table())
    return _READY[model.name]


def mean_loss(texts: list[str], model: Model) -> np.ndarray:
    """Mean negative log-likelihood of each text's code points, NaN for an empty text."""
    symbols, log_p = _ready(model)
    out = np.full(len(texts), np.nan)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < 1 << 19):
            size += len(texts[stop])
            stop += 1
        code, lengths = codes(texts[start:stop], symbols)
        full = np.flatnonzero(lengths)
        if len(full):
            begin = (np.cumsum(lengths) - lengths)[full]
            out[start + full] = -np.add.reduceat(log_p[code].astype(np.float64), begin) / lengths[full]
        start = stop
    return out


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, lang, n, mark, loss`` of every row under the model of all trusted documents, and the limits, both staged."""
    text = F.col(text_col).cast("string")
    fields = ["id", "lang", "n", "mark"]
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.length(text).alias("n"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )
    packed = ngrams.blocks(rows, fields)
    listed = packed.select("block", F.posexplode("rows.id").alias("place", "id"))
    places = listed.join(trusted_ids(labels, id_col), "id").groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    model = ngrams.fit(packed.join(places.hint("merge"), "block"))  # the blocks with trusted texts grow with the corpus
    scored = stage(ngrams.losses(packed, model, fields), "losses")
    return scored, _bounded(thresholds(scored, labels.withColumnRenamed(id_col, "doc_id")))


def thresholds(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, limit``: the quantile of trusted documents' loss, less each one's allowance, by language.

    ``scored`` has ``id, lang, n, loss``.  All trusted documents count.  A language with fewer than
    ``FEWEST_TRUSTED`` gets the limit of all languages together; without any trusted document there is no
    limit and nothing is rejected by it.
    """
    known = scored.join(trusted_ids(labels), "id", "left_semi").where("loss IS NOT NULL")
    known = known.select("lang", (F.col("loss") - F.lit(ALLOWANCE) / F.sqrt("n")).alias("net"))
    at = F.percentile_approx("net", F.lit(quantile), F.lit(20_000))
    by_language = known.groupBy("lang").agg(F.count("*").alias("trusted"), at.alias("limit"))
    overall = known.agg(at.alias("limit")).first()["limit"]
    rest = F.lit(overall).cast("double")
    languages = scored.select("lang").distinct().join(by_language, "lang", "left")
    return languages.select(
        "lang", F.when(F.col("trusted") >= FEWEST_TRUSTED, F.col("limit")).otherwise(rest).alias("limit")
    )


def _kept() -> Column:
    net = F.col("loss") - F.lit(ALLOWANCE) / F.sqrt("n") - F.lit(SLACK)
    return F.col("loss").isNotNull() & (F.coalesce(net <= F.col("limit"), F.lit(True)))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``id, lang, n_chars, perplexity, limit, kept`` for every row; whole texts are scored.

    A null or empty text has null perplexity and is rejected.  A null language is the language ``und``.
    ``limit`` is the perplexity a text of this language and length may have, null where nothing is trusted.
    """
    scored, limits = _judged(docs, labels, id_col, text_col, lang_col)
    judged = scored.join(F.broadcast(limits), "lang")
    return judged.select(
        F.col("id").alias(id_col),
        "lang",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_chars"),
        F.exp("loss").alias("perplexity"),
        F.exp(F.col("limit") + F.lit(SLACK) + F.lit(ALLOWANCE) / F.sqrt(F.greatest("n", F.lit(1)))).alias("limit"),
        _kept().alias("kept"),
    )


def _bounded(limits: DataFrame) -> DataFrame:
    limits = stage(limits, "limits")
    if limits.limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    return limits


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns; rows of one id are told apart by language and text."""
    scored, limits = _judged(docs, labels, id_col, text_col, lang_col)
    kept = scored.join(F.broadcast(limits), "lang").where(_kept())
    kept = kept.select(F.col("id").alias("kept_id"), F.col("lang").alias("kept_lang"), F.col("mark").alias("kept_mark"))
    kept = kept.hint("merge")  # as many rows as documents
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    same = docs[id_col].eqNullSafe(kept["kept_id"]) & (lang == kept["kept_lang"])
    return docs.join(kept, same & (F.xxhash64(docs[text_col].cast("string")) == kept["kept_mark"]), "left_semi")
