"""A training corpus from the table of documents: five stages, each written and read again.

``STAGES`` lists name and function; a function takes the session, the documents so far and the folder of the
tables, and returns what goes on.  All but the last keep the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabfold.llm import bpe, decontam, quality, sketches, suffix
from tabfold.workspace import stage

#: Repeats of over fifty words are removed, however short the words, and all repeats of so many bytes.  The search
#: begins at ``SEARCH_BYTES``: 51 words of two letters have as many or nearly so.
REPEAT_WORDS, REPEAT_BYTES, SEARCH_BYTES = 51, 250, 160

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_filter(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the perplexity classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (runs of five words, similarity 0.8): that with the smallest id.

    Of rows with equal id and text one stays; rows are told apart behind the join by ids, on the same partitions.
    """
    judged = sketches.near_duplicates(docs)
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("gone_id")).hint("merge")
    left = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(F.struct("*").alias("row"), "doc_id")
    mark = F.xxhash64(F.col("row")["text"].cast("string"))
    left = left.withColumn("mark", mark)
    first = Window.partitionBy("doc_id", "mark").orderBy("mark")
    return left.withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents without what repeats elsewhere in runs of over fifty words or of ``REPEAT_BYTES`` bytes.

    A run is what repeated strings of ``SEARCH_BYTES`` cover together, cut at whole code points; lengths follow.
    """
    # the text beside itself would go through every shuffle twice, once uncompressed
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("all"))
    done = suffix.remove_repeats(
        packed, length=SEARCH_BYTES, whole_points=True, least_words=REPEAT_WORDS, least_bytes=REPEAT_BYTES
    )
    text = F.col("kept_text").cast("string")
    renewed = {"text": text}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return done.select(*[renewed.get(c, F.col("all")[c]).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, ids, starts``: tokens and the byte at which each starts."""
    return bpe.encode(docs, RANKS)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Training, components and suffix order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
