"""An interpolated modified Kneser-Ney model over all code points, as a table of contexts that stays in Spark.

A sign is a code point; nothing bounds the alphabet, the number of texts counted or the number of contexts.
The model has one row for each context of 0 to ``ORDER`` - 1 signs, partitioned by context: the signs seen
after it, their discounted shares and the weight of the next shorter context.

Texts are packed into blocks of bounded size.  A block asks once for each context it holds, whatever the
number of times, so no context is asked for more often than there are blocks; the rows found are joined and
come back to the block, which adds up the losses of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabfold.llm.arrays import flat, give_back, short_batches
from tabfold.workspace import stage

ORDER = 4
#: Signs are code points plus one, so that contexts of different length never have one key.
WIDTH = 21
START = 0x110001
POINTS = 0x110000
#: Bytes and rows of texts in one block; a longer single text is a block of its own.
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 20_000
#: Positions worked on at once, and different signs up to which four of them fit 63 bits.
STEP = 1 << 19
LOCAL_SIGNS = 50_000


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (
        1 - 2 * y * n2 / n1 if n1 else 0.5,
        2 - 3 * y * n3 / n2 if n2 else 1.0,
        3 - 4 * y * n4 / n3 if n3 else 1.5,
    )
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def blocks(docs: DataFrame, fields: list[str], text_col: str = "text") -> DataFrame:
    """``block, rows, offsets, packed``: the fields and the texts of many rows, staged.  Null texts are empty."""
    short_batches(docs.sparkSession)
    plain = docs.select(*fields, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("block_text"))
    kinds = ", ".join(f"{f}: {docs.schema[f].dataType.simpleString()}" for f in fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=7).compress
        first = TaskContext.get().partitionId() << 33
        held, size, count, made = [], 0, 0, 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = flat(table.column("block_text"))
            rows = pa.StructArray.from_arrays(
                [c if isinstance(c, pa.Array) else c.combine_chunks() for c in (table.column(f) for f in fields)], names=fields
            )
            listed = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            columns = [pa.array([first + made]), listed, pa.array([offsets.tobytes()]), pa.array([shrink(data.tobytes())])]
            return pa.RecordBatch.from_arrays(columns, ["block", "rows", "offsets", "packed"])

        for batch in batches:
            start = 0
            if not batch.num_rows:
                continue
            _, at = flat(batch.column("block_text"))
            while start < batch.num_rows:
                stop = int(np.searchsorted(at, at[start] + BLOCK_BYTES - size, "right")) - 1
                stop = min(max(stop, start if held else start + 1), batch.num_rows, start + BLOCK_ROWS - count)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(at[stop] - at[start])
                    count += stop - start
                if stop < batch.num_rows or size >= BLOCK_BYTES:
                    yield out()
                    held, size, count, made = [], 0, 0, made + 1
                start = stop
        if held:
            yield out()

    schema = f"block long, rows array<struct<{kinds}>>, offsets binary, packed binary"
    return stage(plain.mapInArrow(pack, schema), "blocks")


def _texts(offsets: bytes, packed: bytes) -> list[str]:
    at = np.frombuffer(offsets, np.int64)
    data = zstandard.decompress(packed)
    return [data[a:b].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signs of texts end to end, each text after ``START`` signs; the places of the texts' own and their lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    pad = ORDER - 1
    total = int(lengths.sum())
    signs = np.full(total + pad * len(texts), START, np.int32)
    place = np.arange(total, dtype=np.int32)
    place += np.repeat(np.arange(pad, pad * (len(texts) + 1), pad, dtype=np.int32), lengths)
    signs[place] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    signs[place] += 1
    return signs, place, lengths


def _grams(signs: np.ndarray, place: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """By stretch of ``place``: the slice, the codes of its n-grams, and the signs whose ranks the codes are made of."""
    start = 0
    while start < len(place):
        stop = min(start + STEP, len(place))
        low = place[start] - ORDER + 1
        seen = np.unique(signs[low : place[stop - 1] + 1])
        if len(seen) > LOCAL_SIGNS:
            stop = min(start + LOCAL_SIGNS // (2 * ORDER), len(place))
            seen = np.unique(signs[low : place[stop - 1] + 1])
        rank = np.zeros(int(seen[-1]) + 1, np.int64)
        rank[seen] = np.arange(len(seen))
        local = rank[signs[low : place[stop - 1] + 1]]
        code = local.copy()
        for back in range(1, ORDER):
            code[back:] += local[:-back] * len(seen) ** back
        yield slice(start, stop), code[place[start:stop] - low], seen.astype(np.int64)
        start = stop


def _parts(code: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the context of ``ORDER`` - 1 signs, and the sign, of codes."""
    rest, sign = np.divmod(code, len(seen))
    key = np.zeros(len(code), np.int64)
    for back in range(ORDER - 1):
        rest, last = np.divmod(rest, len(seen))
        key |= seen[last] << (WIDTH * back)
    return key, seen[sign]


def count(trusted: DataFrame) -> DataFrame:
    """``key, sign, n`` of blocks with the numbers of the texts that count in ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = _texts(batch.column("offsets")[i].as_py(), batch.column("packed")[i].as_py())
                signs, place, _ = _signs([texts[p] for p in batch.column("places")[i].as_py()])
                for _, code, seen in _grams(signs, place):
                    found, n = np.unique(code, return_counts=True)
                    key, sign = _parts(found, seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(sign.astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "sign", "n"]
                    )
        give_back()

    found = trusted.select("offsets", "packed", "places").mapInArrow(run, "key long, sign int, n long")
    return found.groupBy("key", "sign").agg(F.sum("n").alias("n"))


def fit(trusted: DataFrame) -> DataFrame:
    """The model's rows, staged, of blocks with ``places``."""
    grams = count(trusted)
    model = None
    for order in range(ORDER, 0, -1):
        grams = stage(grams, f"grams{order}")
        of = grams.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
        d1, d2, d3 = discounts([of[f"n{k}"] for k in range(1, 5)])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        share = F.greatest(F.col("n") - cut, F.lit(0.0))
        by_context = grams.groupBy("key").agg(
            F.collect_list(F.struct("sign", share.alias("left"))).alias("after"),
            F.sum("n").alias("total"),
            F.sum(cut).alias("freed"),
        )
        rows = by_context.select(
            "key",
            F.col("after.sign").alias("signs"),
            F.transform("after", lambda a: (a["left"] / F.col("total")).cast("float")).alias("shares"),
            (F.col("freed") / F.col("total")).cast("float").alias("weight"),
        )
        model = rows if model is None else model.unionByName(rows)
        shorter = F.col("key").bitwiseAND(F.lit((1 << (WIDTH * max(order - 2, 0))) - 1).cast("long"))
        grams = grams.groupBy(shorter.alias("key"), "sign").agg(F.count("*").alias("n"))
    return stage(model, "model")


def _ordered(found: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys and weights of the model's rows, and pairs of row and sign with their shares; each ends with a default."""
    found = found.sort_by("key").combine_chunks()
    keys = found.column("key").to_numpy()
    weight = np.append(found.column("weight").to_numpy().astype(np.float64), 1.0)
    signs, shares = (found.column(c).chunk(0) for c in ("signs", "shares"))
    pair = np.repeat(np.arange(len(keys)), signs.value_lengths().to_numpy()) << WIDTH
    pair |= signs.flatten().to_numpy()
    order = np.argsort(pair)
    return keys, weight, pair[order], np.append(shares.flatten().to_numpy()[order].astype(np.float64), 0.0)


def _log_p(key: np.ndarray, sign: np.ndarray, rows: tuple[np.ndarray, ...] | None) -> np.ndarray:
    """log p of n-grams, interpolated down to the uniform distribution over all code points."""
    p = np.full(len(key), 1.0 / POINTS)
    if rows is None:
        return np.log(p)
    keys, weight, pair, share = rows
    for length in range(ORDER):
        context = key & ((1 << (WIDTH * length)) - 1)
        at = np.searchsorted(keys, context)
        at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != context)] = len(keys)
        wanted = (at << WIDTH) | sign
        place = np.searchsorted(pair, wanted)
        place[(place == len(pair)) | (pair[np.minimum(place, len(pair) - 1)] != wanted)] = len(pair)
        p = share[place] + weight[at] * p
    return np.log(p)


def losses(packed: DataFrame, model: DataFrame, fields: list[str]) -> DataFrame:
    """The fields of each row of the blocks, and ``loss``: its text's mean negative log-likelihood, null if empty."""
    kinds = packed.schema["rows"].dataType.elementType

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                signs, place, _ = _signs(_texts(batch.column("offsets")[i].as_py(), batch.column("packed")[i].as_py()))
                keys = [_parts(np.unique(code // len(seen)) * len(seen), seen)[0] for _, code, seen in _grams(signs, place)]
                if not keys:
                    continue
                keys = np.unique(np.concatenate(keys))
                shorter = [np.unique(keys & ((1 << (WIDTH * n)) - 1)) for n in range(ORDER - 1)]
                keys = np.concatenate([keys, *shorter])
                block = np.full(len(keys), batch.column("block")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(keys)], ["block", "key"])
        give_back()

    asked = packed.select("block", "offsets", "packed").mapInArrow(ask, "block long, key long")
    answers = asked.join(model.hint("merge"), "key").select("block", "key", "signs", "shares", "weight")

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = _texts(left.column("offsets")[0].as_py(), left.column("packed")[0].as_py())
        signs, place, lengths = _signs(texts)
        each = np.empty(len(place))
        model_rows = _ordered(right) if right.num_rows else None
        for part, code, seen in _grams(signs, place):
            found = np.unique(code)
            each[part] = _log_p(*_parts(found, seen), model_rows)[np.searchsorted(found, code)]
        full = np.flatnonzero(lengths)
        loss = np.zeros(len(texts))
        if len(full):
            loss[full] = -np.add.reduceat(each, (np.cumsum(lengths) - lengths)[full]) / lengths[full]
        rows = left.column("rows").combine_chunks().flatten()
        rows = rows if isinstance(rows, pa.StructArray) else rows.combine_chunks()
        table = pa.table([*[rows.field(f) for f in fields], pa.array(loss, mask=lengths == 0)], names=[*fields, "loss"])
        del left, right, model_rows, each
        give_back()
        return table

    schema = ", ".join(f"{f} {kinds[f].dataType.simpleString()}" for f in fields) + ", loss double"
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)
