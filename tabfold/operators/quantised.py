"""Exact nearest neighbours by a scan over compact codes: scan, bound, refine.

Every vector is coded in two bytes a dimension, as its difference from a pivot in steps of its own, and the length of what
the code leaves out is kept.  So the distance of two codes bounds that of the vectors from below and above.  Tasks compare a
block of coded test rows with a chunk of coded train rows; only pairs whose lower bound is not beyond the k-th upper
bound leave a task, and only these few are measured on the vectors themselves.  The result is exact.

Chunks are rings around pivots and blocks gather test rows of one ring, so blocks and chunks that the triangle
inequality keeps apart never meet; where it keeps nothing apart, as in many dimensions, the scan reads codes alone.
Codes travel packed, a row for each block or chunk, and never by test row and chunk.  Chunks and blocks grow with the
tables, so their numbers stay, and with them the copies of a code and the pairs that leave the tasks for each test row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabfold.operators.joins import join_popular, popular
from tabfold.operators.ranking import SEED, shuffle_key
from tabfold.workspace import stage

CHUNK_ROWS = 16384
BLOCK_ROWS = 16384
MAX_CHUNKS = 65536
#: Chunks and blocks a table is cut into, as long as they stay below ``LARGEST`` rows.
CHUNKS = 16
BLOCKS = 64
LARGEST = 131072
MAX_PIVOTS = 256
RING_GRID = 64
#: Steps of a code on either side of its pivot.
STEPS = 32767
#: Dimensions from which on single precision tells points apart.
NARROW = 16
_PAIRS_PER_STEP = 1 << 21
#: Train rows of a chunk that give its unbounded test rows their bound.
_FIRST_ROWS = 2048


def matrix(column) -> np.ndarray:
    """Arrow list column -> (rows, dimensions) matrix of doubles."""
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0))
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) % rows or np.isnan(flat).any():
        raise ValueError("features must have equal length and no missing values")
    return flat.reshape(rows, -1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (
        np.einsum("ij,ij->i", points, points)[:, None]
        + np.einsum("ij,ij->i", pivots, pivots)[None, :]
        - 2.0 * (points @ pivots.T)
    )
    return np.sqrt(np.maximum(squared, 0.0))


# --- codes


def encode(points: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of ``points`` around ``center`` (one, or one a row), the step of each row, and the length left out."""
    rest = points - center
    step = np.abs(rest).max(axis=1, initial=0.0) / STEPS
    step[step == 0] = 1.0
    codes = np.rint(rest / step[:, None]).astype(np.int16)
    gap = rest - codes * step[:, None]
    # what the sums above may have rounded away
    rounding = 8.0 * np.finfo(np.float64).eps * (np.abs(points).max(axis=1, initial=0.0) + np.abs(center).max(initial=0.0))
    left_out = np.sqrt((gap * gap).sum(axis=1)) * (1.0 + 1e-12) + rounding * math.sqrt(points.shape[1] or 1)
    return codes, step, left_out


@dataclass
class Coded:
    """Rows coded around one pivot."""

    codes: np.ndarray
    step: np.ndarray
    left_out: np.ndarray
    pivot: np.ndarray
    group: np.ndarray | None = None

    def around(self, pivot: np.ndarray) -> np.ndarray:
        """The coded points as differences from another pivot."""
        return self.codes * self.step[:, None] + (self.pivot - pivot)


def _ranked(high: np.ndarray, k: int) -> np.ndarray:
    return np.partition(high, k - 1, axis=1)[:, k - 1]


def _compared(test: Coded, train: Coded, asked: np.ndarray, held: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of some test rows to all train rows, infinite within a group."""
    error = 4.0 * (held.shape[1] + 8) * np.finfo(np.float64).eps
    norms = np.einsum("ij,ij->i", held, held)
    block = asked[rows]
    own = np.einsum("ij,ij->i", block, block)
    squared = own[:, None] + norms[None, :] - 2.0 * (block @ held.T)
    slack = (error * (own + norms.max()))[:, None]
    unsure = test.left_out[rows, None] + train.left_out[None, :]
    low = np.sqrt(np.maximum(squared - slack, 0.0)) - unsure
    high = np.sqrt(np.maximum(squared + slack, 0.0)) + unsure
    if test.group is not None:
        same = test.group[rows, None] == train.group[None, :]
        low[same] = high[same] = np.inf
    return low, high


def _by_rank(test: Coded, train: Coded, asked: np.ndarray, held: np.ndarray, k: int, rows: np.ndarray):
    """Candidates of test rows without a bound."""
    step = max(1, _PAIRS_PER_STEP // len(held))
    for begin in range(0, len(rows), step):
        part = rows[begin : begin + step]
        low, high = _compared(test, train, asked, held, part)
        i, j = np.nonzero((low <= _ranked(high, min(k, len(held)))[:, None]) & np.isfinite(low))
        yield part[i], j, low[i, j], high[i, j]


def _by_bound(test: Coded, train: Coded, asked: np.ndarray, held: np.ndarray, k: int, rows: np.ndarray, bound: np.ndarray):
    """Candidates of test rows whose k-th distance is at most ``bound``: one product tells most pairs apart.

    Single precision does for many dimensions; in a few, points lie closer than it can tell.
    """
    norms = np.einsum("ij,ij->i", held, held)
    own = np.einsum("ij,ij->i", asked[rows], asked[rows])
    width = held.shape[1]
    scale = math.sqrt(max(norms.max(), own.max(initial=0.0))) or 1.0
    kind = np.float32 if width >= NARROW else np.float64
    left = np.ones((len(rows), width + 1), kind)
    left[:, :width] = asked[rows] / scale
    right = np.empty((len(held), width + 1), kind)
    right[:, :width] = held * (-2.0 / scale)
    right[:, width] = norms / scale**2
    # what rounding may add to the sum, whose terms are at most 1 after scaling
    slack = 16.0 * (width + 8) * float(np.finfo(kind).eps)
    reach = (bound + test.left_out[rows] + train.left_out.max()) / scale
    limit = (np.minimum(reach * reach, 8.0) - own / scale**2 + slack).astype(kind)[:, None]
    error = 4.0 * (width + 8) * np.finfo(np.float64).eps
    step = max(1, _PAIRS_PER_STEP // len(held))
    for begin in range(0, len(rows), step):
        flat = np.flatnonzero(left[begin : begin + step] @ right.T <= limit[begin : begin + step])
        i, j = flat // len(held) + begin, flat % len(held)
        if test.group is not None:
            apart = test.group[rows[i]] != train.group[j]
            i, j = i[apart], j[apart]
        squared = np.empty(len(i))
        for at in range(0, len(i), 65536):
            gap = asked[rows[i[at : at + 65536]]] - held[j[at : at + 65536]]
            squared[at : at + 65536] = (gap * gap).sum(axis=1)
        sure = error * (own[i] + norms.max())
        unsure = test.left_out[rows[i]] + train.left_out[j]
        low, high = np.sqrt(np.maximum(squared - sure, 0.0)) - unsure, np.sqrt(squared + sure) + unsure
        order = np.lexsort((high, i))
        i, j, low, high = i[order], j[order], low[order], high[order]
        first = np.searchsorted(i, i)
        last = first + k - 1
        ranked = np.where(i[np.minimum(last, len(i) - 1)] == i, high[np.minimum(last, len(i) - 1)], np.inf) if len(i) else high
        ranked = np.where(last < len(i), ranked, np.inf)
        keep = low <= np.minimum(ranked, bound[i])
        yield rows[i[keep]], j[keep], low[keep], high[keep]


def candidates(test: Coded, train: Coded, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(test index, train index, lower, upper) of the pairs that may be among the k nearest.

    ``bound`` is a known upper bound of the k-th distance of each test row; for rows without one, some of the train rows give it.
    """
    none = np.zeros(0, np.int64)
    if not len(test.codes) or not len(train.codes):
        return none, none, np.zeros(0), np.zeros(0)
    held = train.around(train.pivot)
    asked = test.around(train.pivot)
    bound = np.full(len(asked), np.inf) if bound is None else bound.copy()
    some = max(_FIRST_ROWS, 32 * k)
    if len(held) >= 2 * some:
        spread = np.arange(0, len(held), len(held) // some)[:some]
        sample = Coded(train.codes[spread], train.step[spread], train.left_out[spread], train.pivot, None if train.group is None else train.group[spread])
        # a bound found elsewhere may be loose; in few dimensions every row is near to some of these
        unknown = np.arange(len(bound)) if held.shape[1] < NARROW else np.flatnonzero(np.isinf(bound))
        step = max(1, _PAIRS_PER_STEP // some)
        for begin in range(0, len(unknown), step):
            part = unknown[begin : begin + step]
            bound[part] = np.minimum(bound[part], _ranked(_compared(test, sample, asked, held[spread], part)[1], k))
    known = np.isfinite(bound)
    with_bound, without = np.flatnonzero(known), np.flatnonzero(~known)
    out = [(none, none, np.zeros(0), np.zeros(0))]
    if len(with_bound):
        out.extend(_by_bound(test, train, asked, held, k, with_bound, bound[with_bound]))
    out.extend(_by_rank(test, train, asked, held, k, without))
    return tuple(np.concatenate(part) for part in zip(*out))


# --- packed blocks and chunks


def _code_fields() -> list[T.StructField]:
    return [T.StructField("_step", T.DoubleType()), T.StructField("_left_out", T.DoubleType()), T.StructField("_codes", T.BinaryType())]


def _code_columns(points: np.ndarray, centers: np.ndarray) -> list[pa.Array]:
    codes, step, left_out = encode(points, centers)
    return [pa.array(step), pa.array(left_out), pa.array([c.tobytes() for c in codes], pa.binary())]


def _packed_schema(key: str, id_name: str, id_type: T.DataType, grouped: bool, bounded: bool) -> T.StructType:
    """One row for many: ``key``, the pivot's number, ids, groups, steps, what codes leave out, bounds, codes."""
    many = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    fields = [T.StructField(key, T.IntegerType()), T.StructField(f"{key}_pivot", T.IntegerType()), many(id_name, id_type)]
    fields += [many(f"{key}_grp", T.LongType())] if grouped else []
    fields += [many(f"{key}_step", T.DoubleType()), many(f"{key}_left_out", T.DoubleType())]
    fields += [many(f"{key}_bound", T.DoubleType())] if bounded else []
    return T.StructType([*fields, T.StructField(f"{key}_codes", T.BinaryType())])


def _pack(schema: T.StructType, key: str, id_name: str):
    def pack(rows: pa.Table) -> pa.Table:
        source = {
            key: rows[key][:1],
            f"{key}_pivot": rows["_pivot"][:1],
            id_name: pa.array([rows[id_name].to_pylist()], pa.list_(rows[id_name].type)),
            f"{key}_codes": pa.array([b"".join(rows["_codes"].to_pylist())], pa.binary()),
        }
        for short in ("grp", "step", "left_out", "bound"):
            name = "grp" if short == "grp" else f"_{short}"
            if f"{key}_{short}" in schema.names:
                source[f"{key}_{short}"] = pa.array([rows[name].to_pylist()], pa.list_(rows[name].type))
        return pa.table({n: source[n] for n in schema.names})

    return pack


def _unpack(row: dict, key: str, pivots: np.ndarray) -> Coded:
    step = np.array(row[f"{key}_step"], np.float64)
    group = row.get(f"{key}_grp")
    return Coded(
        np.frombuffer(row[f"{key}_codes"], np.int16).reshape(len(step), -1),
        step,
        np.array(row[f"{key}_left_out"], np.float64),
        pivots[row[f"{key}_pivot"]],
        None if group is None else np.array(group, np.int64),
    )


def pair_schema(test_type: T.DataType, train_type: T.DataType) -> T.StructType:
    bounds = [T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    return T.StructType([T.StructField("test_id", test_type), T.StructField("train_id", train_type), *bounds])


def _meet(blocks: DataFrame, chunks: DataFrame, pairs: DataFrame, pivots: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
    """Candidates of every pair (``_block, _chunk``); a task holds one block and one chunk."""
    names = schema.names

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        test, train = left.to_pylist()[0], right.to_pylist()[0]
        bound = test.get("_block_bound")
        if bound is not None:
            bound = np.array([np.inf if b is None else b for b in bound], np.float64)
        i, j, low, high = candidates(_unpack(test, "_block", pivots), _unpack(train, "_chunk", pivots), k, bound)
        test_ids = left["test_id"].combine_chunks().flatten().take(pa.array(i))
        train_ids = right["train_id"].combine_chunks().flatten().take(pa.array(j))
        return pa.table(dict(zip(names, [test_ids, train_ids, pa.array(low), pa.array(high)])))

    left = blocks.join(pairs, "_block").withColumn("_cell", F.struct("_block", "_chunk")).drop("_chunk")
    right = chunks.join(pairs, "_chunk").withColumn("_cell", F.struct("_block", "_chunk")).drop("_block")
    return left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(kernel, schema)


# --- the search


@dataclass
class Outline:
    """Rings of the train rows, at most ``MAX_PIVOTS`` x ``RING_GRID``: safe to ship to every task."""

    pivots: np.ndarray
    cell: np.ndarray  # pivot of each ring
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    first: np.ndarray  # first chunk number of each ring
    splits: np.ndarray  # chunks of each ring

    def slack(self, gaps: np.ndarray) -> np.ndarray:
        """What rounding may add to distances from pivots."""
        return 1e-9 * (1.0 + float(np.abs(self.high).max(initial=0.0))) + 1e-7 * gaps


def pick_pivots(right: DataFrame, count: int) -> np.ndarray:
    rows = right.orderBy(shuffle_key("train_id", SEED), "train_id").select("features").limit(count).collect()
    return np.unique(np.array([r["features"] for r in rows], np.float64), axis=0)


def _placed(right: DataFrame, k: int, pivots: np.ndarray, grouped: bool) -> DataFrame:
    """Train rows with their nearest pivot, its distance and their code; copies that cannot matter are out."""
    # copies of one vector beyond the k smallest ids can be nobody's neighbour
    same = ["_hash", *(["grp"] if grouped else []), "features"]
    copies = Window.partitionBy(*same).orderBy("train_id")
    fields = list(right.schema.fields)
    right = right.withColumn("_hash", F.xxhash64("features")).withColumn("_n", F.row_number().over(copies))
    right = right.where(F.col("_n") <= k).drop("_n", "_hash")

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("features"))
            gaps = distances(points, pivots)
            cell = gaps.argmin(axis=1)
            columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(cell)), cell])]
            columns += _code_columns(points, pivots[cell])
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_pivot", "_gap", "_step", "_left_out", "_codes"])

    schema = T.StructType([*fields, T.StructField("_pivot", T.IntegerType()), T.StructField("_gap", T.DoubleType()), *_code_fields()])
    return stage(right.mapInArrow(place, schema), "train-codes")


def _ringed(placed: DataFrame, pivots: np.ndarray, chunk_rows: int) -> tuple[DataFrame, Outline]:
    """Train rows with ``_chunk``, and the outline of the rings."""
    spark = placed.sparkSession
    grid = [i / RING_GRID for i in range(1, RING_GRID)]
    borders = placed.groupBy("_pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_gap", grid, 10000).alias("q"))
    edges = []
    for row in borders.collect():  # one row per pivot
        rings = min(RING_GRID, math.ceil(row["n"] / chunk_rows))
        at = [row["q"][round(i * RING_GRID / rings) - 1] for i in range(1, rings)]
        edges.append((row["_pivot"], sorted(set(at))))
    edge_table = spark.createDataFrame(edges, "_pivot int, _edges array<double>")
    # at most MAX_PIVOTS rows of RING_GRID numbers, hence the broadcast
    ringed = placed.join(F.broadcast(edge_table), "_pivot").withColumn("_ring", F.size(F.filter("_edges", lambda e: e < F.col("_gap"))))
    rings = (
        ringed.groupBy("_pivot", "_ring")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_gap").alias("lo"), F.max("_gap").alias("hi"))
        .orderBy("_pivot", "_ring")
        .collect()  # at most MAX_PIVOTS x RING_GRID rows
    )
    splits = np.array([max(1, math.ceil(r["n"] / chunk_rows)) for r in rings])
    first = np.concatenate([[0], np.cumsum(splits)[:-1]])
    outline = Outline(
        pivots,
        np.array([r["_pivot"] for r in rings]),
        np.array([r["lo"] for r in rings]),
        np.array([r["hi"] for r in rings]),
        np.array([r["n"] for r in rings]),
        first,
        splits,
    )
    ring_table = spark.createDataFrame(
        [(r["_pivot"], r["_ring"], int(f), int(s)) for r, f, s in zip(rings, first, splits)], "_pivot int, _ring int, _first int, _splits int"
    )
    chunk = F.col("_first") + F.pmod(F.xxhash64("train_id"), F.col("_splits")).cast("int")
    return ringed.join(F.broadcast(ring_table), ["_pivot", "_ring"]).withColumn("_chunk", chunk), outline


def _homes(left: DataFrame, outline: Outline, k: int) -> DataFrame:
    """Test rows coded around the pivot of their home: the ring that promises k neighbours soonest."""
    fields = [f for f in left.schema.fields if f.name != "features"]

    def home(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("features"))
            gaps = distances(points, outline.pivots)[:, outline.cell]
            reach = gaps + outline.high[None, :] + np.where(outline.rows >= k, 0.0, np.inf)[None, :]
            ring = np.where(np.isfinite(reach).any(axis=1), reach.argmin(axis=1), gaps.argmin(axis=1))
            pivot = outline.cell[ring]
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(ring.astype(np.int32)), pa.array(pivot.astype(np.int32)), *_code_columns(points, outline.pivots[pivot])]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in fields], "_home", "_pivot", "_step", "_left_out", "_codes"])

    schema = T.StructType([*fields, T.StructField("_home", T.IntegerType()), T.StructField("_pivot", T.IntegerType()), *_code_fields()])
    return stage(left.mapInArrow(home, schema), "test-codes")


def _blocked(coded: DataFrame, block_rows: int) -> DataFrame:
    """Adds ``_block``: test rows of one home, at most about ``block_rows``."""
    sizes = coded.groupBy("_home").count().orderBy("_home").collect()  # at most as many as rings
    blocks, first = [], 0
    for row in sizes:
        count = math.ceil(row["count"] / block_rows)
        blocks.append((row["_home"], first, count))
        first += count
    table = coded.sparkSession.createDataFrame(blocks, "_home int, _first int, _count int")
    block = F.col("_first") + F.pmod(F.xxhash64("test_id"), F.col("_count")).cast("int")
    return coded.join(F.broadcast(table), "_home").withColumn("_block", block).drop("_first", "_count")


def _open_chunks(blocks: DataFrame, outline: Outline, homes: DataFrame) -> DataFrame:
    """Pairs (``_block, _chunk``) beyond the home that the bounds of the block's rows leave open."""
    chunks_of = [np.arange(f, f + s, dtype=np.int32) for f, s in zip(outline.first, outline.splits)]

    def route(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                held = _unpack(row, "_block", outline.pivots)
                points = held.around(np.zeros_like(held.pivot))
                gaps = distances(points, outline.pivots)[:, outline.cell]
                unsure = outline.slack(gaps) + held.left_out[:, None]
                floor = np.maximum(gaps - outline.high[None, :], outline.low[None, :] - gaps) - unsure
                bound = np.array([np.inf if b is None else b for b in row["_block_bound"]])
                wanted = np.flatnonzero((floor <= bound[:, None]).any(axis=0))
                found.append([c for r in wanted if r != row["_home"] for c in chunks_of[r].tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("_block"), pa.array(found, pa.list_(pa.int32()))], ["_block", "_chunks"])

    routed = blocks.join(homes, "_block").mapInArrow(route, "_block int, _chunks array<int>")
    return routed.select("_block", F.explode("_chunks").alias("_chunk"))


def scan(left: DataFrame, right: DataFrame, k: int, train_count: int, chunk_rows: int, block_rows: int) -> DataFrame:
    """Pairs ``test_id, train_id, low, high`` among which are the k nearest train rows of every test row.

    ``left`` has ``test_id, features``, ``right`` has ``train_id, features``, both may have ``grp``: rows of equal group are
    not compared.  ``low`` and ``high`` bound the distance.  More pairs than k remain where bounds overlap.
    """
    grouped = "grp" in right.columns
    chunk_rows = max(chunk_rows, min(LARGEST, math.ceil(train_count / CHUNKS)), math.ceil(train_count / MAX_CHUNKS))
    block_rows = max(block_rows, min(LARGEST, math.ceil(left.count() / BLOCKS)))
    pivots = pick_pivots(right, min(MAX_PIVOTS, max(2, math.ceil(train_count / chunk_rows))))
    placed = _placed(right.select("train_id", "features", *(["grp"] if grouped else [])), k, pivots, grouped)
    chunked, outline = _ringed(placed, pivots, chunk_rows)
    train_type, test_type = right.schema["train_id"].dataType, left.schema["test_id"].dataType
    schema = _packed_schema("_chunk", "train_id", train_type, grouped, False)
    chunks = stage(chunked.groupBy("_chunk").applyInArrow(_pack(schema, "_chunk", "train_id"), schema), "chunks")

    coded = stage(_blocked(_homes(left, outline, k), block_rows), "test-blocks")
    homes = coded.groupBy("_block").agg(F.first("_home").alias("_home"))
    own = [(r, int(f + i)) for r, (f, s) in enumerate(zip(outline.first, outline.splits)) for i in range(s)]
    own_chunks = left.sparkSession.createDataFrame(own, "_home int, _chunk int")  # a row for each chunk
    schema = _packed_schema("_block", "test_id", test_type, grouped, False)
    blocks = coded.groupBy("_block").applyInArrow(_pack(schema, "_block", "test_id"), schema)
    pair = pair_schema(test_type, train_type)
    near = stage(_meet(blocks, chunks, homes.join(own_chunks, "_home").select("_block", "_chunk"), pivots, k, pair), "near")

    place = Window.partitionBy("test_id").orderBy("high")
    bounds = near.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).where(F.col("_n") == k)
    bounded = coded.join(bounds.select("test_id", F.col("high").alias("_bound")), "test_id", "left")
    schema = _packed_schema("_block", "test_id", test_type, grouped, True)
    blocks = stage(bounded.groupBy("_block").applyInArrow(_pack(schema, "_block", "test_id"), schema), "test-bounds")
    pairs = stage(_open_chunks(blocks, outline, homes), "open")
    return narrowed(near.unionByName(_meet(blocks, chunks, pairs, pivots, k, pair)), k)


def narrowed(pairs: DataFrame, k: int) -> DataFrame:
    """Without the pairs that lie beyond the k-th upper bound of their test row."""
    whole = Window.partitionBy("test_id").orderBy("high").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limited = pairs.withColumn("_limit", F.nth_value("high", k).over(whole))
    return limited.where("_limit IS NULL OR low <= _limit").drop("_limit")


def refine(pairs: DataFrame, left: DataFrame, right: DataFrame, schema: T.StructType) -> DataFrame:
    """The exact distance of each pair, with the columns of ``schema`` (of ``test_id, train_id, dist, payload, train_features``).

    A train row near to all is met in a broadcast join, see ``join_popular``.
    """
    pairs = stage(pairs.select("test_id", "train_id"), "candidates")
    wanted = pairs.groupBy("train_id").agg(F.count(F.lit(1)).alias("_asked"))
    held = right.drop("grp").withColumnRenamed("features", "train_features").join(wanted, "train_id")
    met = join_popular(pairs, held, ["train_id"], popular(F.col("_asked"), pairs.count())).drop("_asked")
    met = met.join(left.select("test_id", "features"), "test_id")

    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            gap = matrix(batch.column("features")) - matrix(batch.column("train_features"))
            made = {"dist": pa.array(np.sqrt((gap * gap).sum(axis=1)))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in schema.names], schema.names)

    return met.mapInArrow(measure, schema)
