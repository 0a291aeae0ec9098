"""Exact removal of repeated byte strings with a sparse, range-partitioned suffix array.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else, in the same or
another document.  Not every suffix is sorted.  Of each window of ``length`` bytes the anchor is the gram of
``GRAM`` bytes with the smallest hash, the leftmost of equals: equal windows have their anchor at the same
place, so two windows are equal only if suffixes at anchors agree to the right and their contexts to the
left.  Neighbouring windows mostly share an anchor, which leaves about one suffix in 170 bytes.

1. Anchors are counted by gram; a gram that occurs once has no repeated window.  Where all contexts (the
   windows of an anchor laid together) of a gram are equal, all their windows repeat.
2. One example of every other context is cut out and dealt into ranges of the leading bytes of its suffix
   by sampled splitters.  A bucket sorts suffixes and reversed left contexts by multikey quicksort; the
   common prefixes of neighbours tell for every window whether another one equals it.
3. A gram with many contexts may lie across boundaries of buckets: its windows are compared across them by
   128-bit hashes.
4. Spans go back to their documents.

No step needs the rows of a gram together, however many documents share it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from tabfold.llm.arrays import Rolling, flat, short_batches, slices
from tabfold.operators.joins import join_popular, popular
from tabfold.workspace import stage

LENGTH = 400
GRAM = 64
LEAD = 16
CHUNK = 1 << 20
POSITION_BITS = 21
PIECES_PER_BUCKET = 20_000
#: Contexts of one gram up to which they stay in one bucket.
WHOLE_GROUP = 5_000
SMALL = 24


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(blocks, width)
    forth = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:count], forth[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the texts: text, position, first and last window start, gram hash, context hash."""
    parts = []
    total = len(data) - length + 1
    mask = np.uint64((1 << POSITION_BITS) - 1)
    view = memoryview(np.ascontiguousarray(data))
    for base in range(0, max(total, 0), CHUNK):
        stop = min(base + CHUNK, total)
        hashes = Rolling(data[base : stop + length - 1]).windows(gram)
        packed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        at = (_sliding_min(packed, length - gram + 1) & mask).astype(np.int64)
        start = np.arange(base, stop)
        text = np.searchsorted(offsets, start, "right") - 1
        inside = start + length <= offsets[text + 1]
        at, start, text = at[inside], start[inside], text[inside]
        if not len(at):
            continue
        edge = np.flatnonzero((at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
        first = np.append(0, edge + 1)
        last = np.append(edge, len(at) - 1)
        low, high = start[first], start[last]
        context = np.fromiter(
            (xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(low.tolist(), (high + length).tolist())), np.uint64, len(low)
        )
        parts.append((text[first], at[first] + base, low, high, hashes[at[first]], context))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(column) for column in zip(*parts))


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: three-way partition on one word, the equal part goes on to the next."""
    rows, depth_end = keys.shape
    order = np.arange(rows)
    stack = [(0, rows, 0)]
    while stack:
        low, high, depth = stack.pop()
        size = high - low
        if size < 2 or depth == depth_end:
            continue
        own = order[low:high]
        if size <= SMALL:
            order[low:high] = sorted(own.tolist(), key=lambda i: keys[i, depth:].tolist())
            continue
        word = keys[own, depth]
        pivot = np.sort(word[:: max(1, size // 9)])[4]
        less, more = word < pivot, word > pivot
        same = ~(less | more)
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([own[less], own[same], own[more]])
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows, and the common prefix of each with the one before it (the first: 0)."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    order = multikey_quicksort(padded.view(">u8").astype(np.uint64))
    common = np.zeros(len(rows), np.int64)
    for start in range(1, len(rows), 4096):
        here = rows[order[start : start + 4096]]
        differs = here != rows[order[start - 1 : start - 1 + len(here)]]
        common[start : start + len(here)] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, prefix: int) -> np.ndarray:
    """A number for each row, equal for rows with the same first ``prefix`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < prefix)
    return out


def repeated(data: np.ndarray, offsets: np.ndarray, back: np.ndarray, ahead: np.ndarray, length: int) -> np.ndarray:
    """``[i, d]``: whether the window of context ``i`` that starts ``d`` bytes before its anchor has an equal elsewhere.

    ``back`` and ``ahead`` are the largest and smallest ``d`` of each context.
    """
    count = len(back)
    widest = int(back.max()) + 1
    anchor = offsets[:-1] + back
    column = np.arange(length)
    at = anchor[:, None] + column
    right = np.where(at < offsets[1:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    at = anchor[:, None] - 1 - np.arange(max(widest - 1, 1))
    left = np.where(at >= offsets[:-1, None], data[np.maximum(at, 0)], 0).astype(np.uint8)
    right_order, right_common = _sorted(right)
    left_order, left_common = _sorted(left)
    out = np.zeros((count, widest), bool)
    for d in range(widest):
        active = np.flatnonzero((ahead <= d) & (d <= back))
        if len(active) < 2:
            continue
        key = _classes(right_order, right_common, length - d)[active] * (count + 1)
        key += _classes(left_order, left_common, d)[active]
        rank = np.argsort(key, kind="stable")
        key = key[rank]
        same = key[1:] == key[:-1]
        twin = np.zeros(len(key), bool)
        twin[1:] |= same
        twin[:-1] |= same
        out[active[rank], d] = twin
    return out


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Inclusive runs of a boolean row."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


_FOUND = "gram long, context long, near int, far int, w1 long, w2 long"


def _bucket(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]  # PIECES_PER_BUCKET of them, by sampled splitters
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    data, offsets = flat(table.column("piece"))
    gram, context, copies, back, ahead = (
        table.column(c).to_numpy().astype(np.int64) for c in ("gram", "context", "copies", "back", "ahead")
    )
    twins = repeated(data, offsets, back, ahead, length)
    rows: list[tuple] = []
    for i in np.flatnonzero((copies == 1) & twins.any(axis=1)):
        rows += [(gram[i], context[i], a, b, None, None) for a, b in _runs(twins[i])]
    raw = data.tobytes()
    seen: set[bytes] = set()
    for i in np.flatnonzero(table.column("tie").to_numpy() != 0).tolist():
        for d in range(ahead[i], back[i] + 1):
            at = offsets[i] + back[i] - d
            digest = xxhash.xxh3_128_digest(raw[at : at + length])
            if digest not in seen:  # one of equal windows stands for all of them elsewhere
                seen.add(digest)
                rows.append((gram[i], context[i], d, d, *np.frombuffer(digest, np.int64).tolist()))
        if len(rows) > 100_000:
            yield _found_batch(rows)
            rows = []
    if rows:
        yield _found_batch(rows)


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    columns = [pa.array([None if v is None else int(v) for v in c], k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FOUND.split(", ")])


def _merged(spans: list[dict] | None, data: bytes, whole_points: bool) -> list[tuple[int, int]]:
    """Maximal runs of the spans; with ``whole_points`` shrunk to whole UTF-8 sequences."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    if not whole_points:
        return out
    shrunk = []
    for start, stop in out:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            shrunk.append((start, stop))
    return shrunk


def _keys(id_col: str, text: str) -> list:
    return [F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.col(text)).alias("k2")]


def _packed(source: DataFrame) -> DataFrame:
    """The text compressed, for the shuffles it goes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            raw = memoryview(np.ascontiguousarray(data))
            ends = offsets.tolist()
            packed = pa.array([shrink(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "k1", "k2")] + [packed], ["row", "k1", "k2", "packed"])

    names = ["row", "k1", "k2"]
    return source.mapInArrow(run, StructType([source.schema[n] for n in names]).add("packed", "binary"))


def _spans(source: DataFrame, length: int, gram: int, whole_group: int) -> DataFrame:
    """``k1, k2, spans`` of every text that has a repeated window."""
    spark = source.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            text, at, low, high, grams, contexts = anchors(data, offsets, length, gram)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(rows),
                    batch.column("k2").take(rows),
                    pa.array(grams.astype(np.int64)),
                    pa.array(contexts.astype(np.int64)),
                    pa.array((at - offsets[text]).astype(np.int32)),
                    pa.array((at - low).astype(np.int32)),
                    pa.array((at - high).astype(np.int32)),
                ],
                ["k1", "k2", "gram", "context", "at", "back", "ahead"],
            )

    keyed = source.select("k1", "k2", "text")
    found = keyed.mapInArrow(find, "k1 long, k2 long, gram long, context long, at int, back int, ahead int")
    found = stage(found, "anchors")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"))
    grams = stage(grams.where("n > 1").select("gram", (F.col("c0") != F.col("c1")).alias("mixed"), "n"), "grams")
    several = stage(join_popular(found, grams, ["gram"], popular(F.col("n"), found.count())).drop("n"), "several")
    whole = several.where("NOT mixed")
    mixed = several.where("mixed").drop("mixed")
    example = F.min(F.struct("k1", "k2", "at", "back", "ahead")).alias("one")
    contexts = mixed.groupBy("gram", "context").agg(F.count("*").alias("copies"), example)
    contexts = stage(contexts.select("gram", "context", "copies", "one.*"), "contexts")
    large = contexts.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > whole_group)
    large = stage(large.select(F.col("gram").alias("large")), "large")

    # one example of each context, cut out of its document
    tie = F.when(F.col("large").isNotNull(), F.col("context").bitwiseOR(1)).otherwise(0).alias("tie")
    sized = contexts.join(large, F.col("gram") == F.col("large"), "left").withColumn("tie", tie)
    wanted = sized.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("gram", "context", "tie", "copies", "at", "back", "ahead")).alias("cuts")
    )
    texts = _packed(keyed.withColumn("row", F.struct(F.lit(0).alias("none"))))
    lifted = wanted.join(texts, ["k1", "k2"]).select("cuts", "packed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "context", "tie", "copies", "back", "ahead", "lead", "piece"]
        for batch in slices(batches, "packed", 1 << 18):
            rows = []
            for cuts, packed in zip(batch.column("cuts").to_pylist(), batch.column("packed")):
                text = zstandard.decompress(packed.as_py())
                for c in cuts:
                    piece = text[c["at"] - c["back"] : c["at"] - c["ahead"] + length]
                    lead = text[c["at"] : c["at"] + min(LEAD, gram)]
                    rows.append((c["gram"], c["context"], c["tie"], c["copies"], c["back"], c["ahead"], lead, piece))
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    pieces = lifted.mapInArrow(
        cut, "gram long, context long, tie long, copies long, back int, ahead int, lead binary, piece binary"
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, contexts.count() // PIECES_PER_BUCKET + 1)
    ranged = stage(pieces, "pieces").repartitionByRange(buckets, "lead", "gram", "tie")
    judged = stage(ranged.mapInArrow(lambda batches: _bucket(batches, length), _FOUND), "judged")
    inner = judged.where("w1 IS NULL").select("gram", "context", "near", "far")
    outer = judged.where("w1 IS NOT NULL")
    twice = outer.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    across = outer.join(twice, ["w1", "w2"], "left_semi").select("gram", "context", "near", "far")
    runs = inner.union(across).groupBy("gram", "context").agg(F.collect_list(F.struct("near", "far")).alias("runs"))

    # the windows of a context that repeat, as the byte spans they cover in its documents
    single = contexts.where("copies = 1").select("gram", "context", "k1", "k2", "at")
    partly = runs.join(single, ["gram", "context"])
    frequent = contexts.where("copies > 1").select("gram", "context", "copies")
    copied = join_popular(mixed, frequent, ["gram", "context"], popular(F.col("copies"), mixed.count()))
    all_of = F.array(F.struct(F.col("ahead").alias("near"), F.col("back").alias("far"))).alias("runs")
    every = whole.select("k1", "k2", "at", all_of).union(copied.select("k1", "k2", "at", all_of))
    every = every.union(partly.select("k1", "k2", "at", "runs"))
    spans = F.transform(
        "runs",
        lambda r: F.struct((F.col("at") - r["far"]).alias("start"), (F.col("at") - r["near"] + length).alias("stop")),
    )
    gathered = every.select("k1", "k2", spans.alias("spans")).groupBy("k1", "k2")
    return gathered.agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    whole_points: bool = False,
    whole_group: int = WHOLE_GROUP,
    least_words: int = 0,
    least_bytes: int = 0,
) -> DataFrame:
    """Every row with its columns but the text, and ``removed_spans`` and ``kept_text`` (bytes).

    With ``least_words``, runs of fewer words stay unless they have ``least_bytes`` bytes.  Columns of the
    input with the names of the two new ones are replaced.

    Texts are UTF-8 bytes, a null text is empty; strings are judged on the input.  Spans are the maximal
    removed runs, ``start`` inclusive and ``stop`` exclusive; with ``whole_points`` they are shrunk to whole
    code points, so that ``kept_text`` is valid UTF-8.  Rows repeated with id and text are documents of
    their own: each repeats the other.  A text shorter than ``length`` is kept whole.
    """
    short_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text_col, "removed_spans", "kept_text")]
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(id_col).alias("id"),
    ).select("row", "text", *_keys("id", "text"))
    spans = _spans(source, length, gram, whole_group)
    joined = _packed(source).join(spans, ["k1", "k2"], "left").select("row", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 19):
            runs, texts = [], []
            for packed, spans in zip(batch.column("packed"), batch.column("spans").to_pylist()):
                data = zstandard.decompress(packed.as_py())
                own = _merged(spans, data, whole_points)
                if least_words:
                    own = [(a, b) for a, b in own if b - a >= least_bytes or len(data[a:b].split()) >= least_words]
                runs.append([{"start": a, "stop": b} for a, b in own])
                edges = [0, *[e for span in own for e in span], len(data)]
                texts.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(runs, span), pa.array(texts, pa.binary())], ["row", "removed_spans", "kept_text"]
            )

    span_type = ArrayType(StructType().add("start", "integer").add("stop", "integer"))
    out = joined.mapInArrow(run, StructType([source.schema["row"]]).add("removed_spans", span_type).add("kept_text", "binary"))
    return out.select("row.*", "removed_spans", "kept_text")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, repeats`` of every row.

    ``n_kept`` counts the bytes that stay, ``repeats`` tells whether any were removed.
    """
    done = remove_repeats(docs.select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return done.select(
        "doc_id",
        (F.octet_length("kept_text") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.octet_length("kept_text").cast("long").alias("n_kept"),
        (removed > 0).alias("repeats"),
    )
