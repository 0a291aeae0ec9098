"""The operations of this subpackage as queries over the test tables, with equal SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabfold.llm import (
    bpe,
    conversations,
    decontam,
    fingerprint,
    language,
    licenses,
    quality,
    sharding,
    sketches,
    spelling,
    suffix,
    urls,
    warc,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

SHARDS = 16

#: Host, path and verdict of the url rules. Fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predictions(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.digests(_table(spark, folder, "documents"))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.near_duplicates(_table(spark, folder, "documents"), 4)


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(_table(spark, folder, "documents").select("doc_id", path.alias("path"), "text"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return urls.judge(pages, urls.links(pages), URL_RULES)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(_table(spark, folder, "documents"), SHARDS)


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"), RANKS)


def op10_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.against_next(_table(spark, folder, "documents"))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(_table(spark, folder, "documents"))


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.shared_beginnings(_table(spark, folder, "conversations"))


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_language": op1_language,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licenses": op5_licenses,
    "op6_url_filter": op6_url_filter,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_fingerprint": op10_fingerprint,
    "op11_spelling": op11_spelling,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}
ORACLES = {
    "op2_decontamination": decontam.leaks_sql(),
    "op6_url_filter": urls.judge_sql(URL_RULES),
    "op11_spelling": spelling.variants_sql(),
    "op12_conversation_trie": conversations.shared_beginnings_sql(),
    "op13_warc": warc.round_trip_sql(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
