"""Document fingerprints by consistent weighted sampling.

A document is a bag of words; the weight of a term is its count.  For every hash function the sample of a
weighted bag is drawn with gamma variates that depend only on the function and the term, so two bags draw
the same sample with a probability equal to their generalised Jaccard similarity, sum(min) / sum(max).
Terms are 64-bit hashes of words, each weighed by itself; its variates are scrambles of the whole hash and
the number of the function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from tabfold.llm.arrays import BASE, flat, mix, short_batches, slices, text_list, words
from tabfold.workspace import stage

FUNCTIONS = 64
#: Different terms, and weighted terms of texts, worked on at once.
TERMS = 1 << 12
PAIRS = 1 << 14


@lru_cache(maxsize=2)
def _salts(functions: int) -> np.ndarray:
    """One 64-bit word for each of three streams and each function."""
    return mix(np.arange(1, 3 * functions + 1, dtype=np.uint64) * np.uint64(BASE)).reshape(3, functions)


def _halves(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers inside (0, 1) of the halves of 64-bit words."""
    scale = np.float32(2.0**-24)
    high = ((bits >> np.uint64(41)).astype(np.float32) * np.float32(2) + np.float32(1)) * scale
    low = ((bits & np.uint64((1 << 23) - 1)).astype(np.float32) * np.float32(2) + np.float32(1)) * scale
    return high, low


def variates(term: np.ndarray, functions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 64-bit term and function: r and log c from Gamma(2, 1), beta from U(0, 1)."""
    salts = _salts(functions)
    spread = mix(term)[:, None]
    a, b = _halves(mix(spread ^ salts[0]))
    r = -np.log(a * b)
    a, b = _halves(mix(spread ^ salts[1]))
    log_c = np.log(-np.log(a * b))
    return r, log_c, _halves(mix(spread ^ salts[2]))[0]


def _keys(term: np.ndarray, at: np.ndarray, weight: np.ndarray, functions: int) -> Iterator[tuple[slice, np.ndarray]]:
    """log a of weighted terms ``term[at]`` under each function, by stretch; the smallest is the sample.

    t = floor(log w / r + beta); log a = log c + r (beta - t - 1).  The value tells (term, t) apart.
    """
    tables = variates(term, functions)
    one = tables[1] + tables[0] * (tables[2] - np.float32(1.0))
    for start in range(0, len(at), PAIRS):
        part = slice(start, start + PAIRS)
        out = one[at[part]]
        many = np.flatnonzero(weight[part] > 1)
        if len(many):
            r, log_c, beta = (table[at[part][many]] for table in tables)
            t = np.floor(np.log(weight[part][many]).astype(np.float32)[:, None] / r + beta)
            out[many] = log_c + r * (beta - t - np.float32(1.0))  # bit for bit as above where t is 0
        yield part, out


def signatures(data: np.ndarray, offsets: np.ndarray, functions: int = FUNCTIONS) -> np.ndarray:
    """One row of ``functions`` samples for each text laid end to end; a text without words has NaN."""
    count = len(offsets) - 1
    out = np.full((count, functions), np.nan, np.float32)
    text, _, _, term = words(data, offsets)
    if not len(text):
        return out
    # weights by term and text: equal pairs meet after one sort, the variates of a term are made once
    order = np.lexsort((text, term))
    owner, term = text[order].astype(np.int64), term[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])))
    weight = np.diff(np.append(first, len(owner)))
    owner, term = owner[first], term[first]
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    ends = np.append(starts, len(term))
    for start in range(0, len(starts), TERMS):
        some = ends[start : start + TERMS + 1]
        low, high = some[0], some[-1]
        at = np.repeat(np.arange(len(some) - 1), np.diff(some))
        for part, keys in _keys(term[some[:-1]], at, weight[low:high], functions):
            own = owner[low:high][part]
            turn = np.argsort(own, kind="stable")
            own = own[turn]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(keys[turn], begin, axis=0)
            out[own[begin]] = np.fmin(out[own[begin]], least)
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal samples; two empty bags are alike, an empty one is like no other."""
    empty, also = np.isnan(one[0]), np.isnan(other[0])
    if empty or also:
        return 1.0 if empty and also else 0.0
    return float(np.mean(one == other))


def to_hex(signature: np.ndarray) -> str:
    """64 bits that stand for the whole signature: equal signatures, equal text."""
    return signature.tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), np.float32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", functions: int = FUNCTIONS) -> DataFrame:
    """``id, fingerprint`` (hex of ``functions`` samples) for every row; a null text is empty."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = signatures(*flat(batch.column("text")), functions)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([to_hex(s) for s in found])], [id_col, "fingerprint"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {key}, fingerprint string")


_ROWS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, edge string, own string"
)


def _judge(keys: list, texts: list[str], following: list[str], edges: list[str | None], functions: int) -> pa.RecordBatch:
    """One result row for each text and the text after it."""
    edited = []
    for text, after in zip(texts, following):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    count = len(texts)
    blobs = [t.encode() for t in (*texts, *following[-1:], *edited)]
    sizes = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum([len(b) for b in blobs], out=sizes[1:])
    found = signatures(np.frombuffer(b"".join(blobs), np.uint8), sizes, functions)
    own, changed = found[:count], found[count + len(following[-1:]) :]
    after = found[1 : count + 1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array([to_hex(s) for s in own]),
            pa.array([to_hex(s) for s in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
            pa.array(edges, pa.string()),
            pa.array([None] * count, pa.string()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edge", "own"],
    )


def _edge(key: int | None, text: str, kind: str) -> pa.RecordBatch:
    """A text at the edge of a range, to be judged when its neighbour is known."""
    values = {"doc_id": key, "edge": kind, "own": text}
    names = [part.split()[0] for part in _ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(names, kinds)], names)


def _groups(rows: Iterator[tuple[int | None, str]], limit: int) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= limit:
            yield held
            held, size = held[-1:], 0  # the last one waits for its neighbour
    if held:
        yield held


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", functions: int = FUNCTIONS) -> DataFrame:
    """Fingerprints of every text, of its edited form, and how near they and the next document are.

    The next document is the one with the next id (null ids first, equal ids in the order of a checksum of
    the text), after the last the first; a single document follows itself.  The edited text has its last
    floor(n / 2) code points replaced by the first as many, or all, of the next.  Null texts are empty.

    Texts are dealt once into sampled ranges of ids and read in order; each range also hands out its first
    and last text, and those few rows, two a range, are paired in a second step.
    """
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(text.cast("binary")).alias("crc"), text.alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            packed = pa.array([shrink(t.encode()) for t in text_list(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("crc"), packed], ["id", "crc", "packed"])

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), "crc"]
    packed = source.mapInArrow(pack, "id long, crc long, packed binary")  # the texts are shuffled compressed
    ranged = packed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str]]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            column = batch.column("packed")
            for i in range(batch.num_rows):
                yield ids[i], zstandard.decompress(column[i].as_py()).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for group in _groups(rows(batches), 1 << 19):
            if last is None:
                yield _edge(*group[0], "first")
            if len(group) > 1:
                texts = [t for _, t in group]
                keys = [k for k, _ in group[:-1]]
                yield _judge(keys, texts[:-1], texts[1:], [None] * len(keys), functions)
            last = group[-1]
        if last is not None:
            yield _edge(*last, "last")

    done = stage(ranged.mapInArrow(run, _ROWS).withColumn("part", F.spark_partition_id()), "fingerprints")
    edges = done.where("edge IS NOT NULL").select("part", "edge", "doc_id", "own")
    # two short lists, one row a range each: the end of a range is followed by the start of the next
    first = edges.where("edge = 'first'").select("part", F.col("own").alias("after"))
    turn = Window.orderBy("part")
    first = first.withColumn("n", F.row_number().over(turn))
    last = edges.where("edge = 'last'").select("part", "doc_id", "own").withColumn("n", F.row_number().over(turn))
    size = edges.where("edge = 'last'").agg(F.count("*").alias("size"))
    last = last.join(F.broadcast(size)).withColumn("n", F.col("n") % F.col("size") + 1)
    seams = last.join(first, "n").select(F.col("doc_id").alias("id"), "own", "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i in range(batch.num_rows):
                yield _judge([ids[i]], [batch.column("own")[i].as_py()], [batch.column("after")[i].as_py()], [None], functions)

    seamed = seams.mapInArrow(close, _ROWS)
    out = done.where("edge IS NULL").drop("part").unionByName(seamed).drop("edge", "own")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
