"""Language identification by compression.

A text belongs to the language whose raw-content dictionary makes it smallest under zstandard.  The
dictionaries are the whole model: each holds text of a bounded sample of labelled rows.  A choice whose
margin over the runner-up is narrow is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tabfold.llm.arrays import short_batches, slices, text_list
from tabfold.workspace import stage

#: Bounds of the sample: labelled rows of one language, code points of one row, bytes of one dictionary.
ROWS_PER_LANGUAGE = 400
PARTS = 64
POINTS_PER_ROW = 2_000
DICTIONARY_BYTES = 1 << 17
LANGUAGES = 512
#: Search parameters of the compressor: short matches, tables wide enough for a whole dictionary.
SEARCH = {"window_log": 20, "hash_log": 17, "chain_log": 17, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_GREEDY}
UNKNOWN = "und"

_LETTER, _NO_WORD = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")


def normal(text: str) -> str:
    """Words in lower case with their marks, one blank apart; other signs say nothing of a language.  Empty without a letter."""
    return _NO_WORD.sub(" ", text.lower()).strip() if _LETTER.search(text) else ""


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows, the most frequent language first.

    What is learned is bounded: the first ``ROWS_PER_LANGUAGE`` different texts of a language in the order of a
    hash, of each at most ``POINTS_PER_ROW`` code points, of all at most ``DICTIONARY_BYTES``.  Equal texts
    count once; hashes are taken in two steps, so a language with most of the rows is no large group.  Rows
    without language or without a letter are left out.  More than ``LANGUAGES`` languages are an error.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    languages = [r["lang"] for r in common.limit(LANGUAGES + 1).collect()]
    # the smallest hashes of a language, cut in each part before the parts meet
    first = Window.partitionBy("lang", F.pmod("h", F.lit(PARTS))).orderBy("h")
    picked = rows.select("lang", "h").distinct().withColumn("n", F.row_number().over(first))
    picked = picked.where(F.col("n") <= 8 * ROWS_PER_LANGUAGE // PARTS)
    picked = picked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = stage(picked.where(F.col("n") <= ROWS_PER_LANGUAGE).select("lang", "h"), "picked")
    rows = rows.join(F.broadcast(picked), ["lang", "h"]) if len(languages) <= LANGUAGES else rows.limit(0)
    rows = rows.groupBy("lang", "h").agg(F.min(F.substring("text", 1, POINTS_PER_ROW)).alias("text"))
    rows = stage(rows, "sample")
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    out: dict[str, bytes] = {}
    for lang in languages:
        sample = rows.where(F.col("lang") == lang).orderBy("h", "text").select("text").collect()
        lines = [line for line in dict.fromkeys(normal(r["text"]) for r in sample) if line]
        content = "\n".join(lines).encode()[-DICTIONARY_BYTES:]
        if content:
            out[lang] = content
    return out


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(write_content_size=False, **SEARCH)
        data.precompute_compress(compression_params=how)
        out.append((lang, zstandard.ZstdCompressor(dict_data=data, compression_params=how)))
    return out


def classify(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """Language and margin: by how much the smallest form undercuts the second, as a share of the second."""
    content = normal(text).encode() if text is not None else b""
    if not content or not compressors:
        return UNKNOWN, 0.0
    sizes = sorted((len(c.compress(content)), i) for i, (_, c) in enumerate(compressors))
    best = compressors[sizes[0][1]][0]
    return best, 1.0 if len(sizes) == 1 else 1.0 - sizes[0][0] / sizes[1][0]


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    id_col: str = "doc_id",
    text_col: str = "text",
    min_margin: float = 0.01,
) -> DataFrame:
    """``id, lang_pred, score, rejected``, one row per input row.

    ``lang_pred`` is the best language, ``und`` for a null text or one without a letter (score 0); ties go to
    the more frequent language.  ``score`` is the margin, 1 with a single language.  ``rejected`` holds where
    the margin is below ``min_margin``.  Whole texts are compressed.
    """
    key = docs.schema[id_col].dataType.simpleString()
    short_batches(docs.sparkSession)
    model = tuple(dictionaries.items())
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most LANGUAGES x DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(shared.value)
        for batch in slices(batches, "text"):
            found = [classify(t, compressors) for t in text_list(batch.column("text"))]
            scores = [s for _, s in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([lang for lang, _ in found], pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([s < min_margin for s in scores], pa.bool_()),
                ],
                [id_col, "lang_pred", "score", "rejected"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {key}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, predicts all."""
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
