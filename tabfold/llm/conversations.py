"""Prefix trie of conversations, its totals rolled up in bands of depth.

A node is a sequence of first turns.  It is named by its depth and two 64-bit sums (exclusive or) of hashes of its turns
with their positions, so names are prefix sums and long conversations are named in blocks.

Totals of subtrees: a node gives its value to its ancestors inside a band of ``BAND`` depths, so nothing explodes to
more rows than that.  The tops of the bands then are a tree of their own, ``BAND`` times lower, which is rolled up in the
same way; its totals come back down to the band above each top.  The rounds are the logarithm of the depth to the base ``BAND``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabfold.llm import duck
from tabfold.operators.joins import join_popular, popular
from tabfold.operators.ranking import rank_by_value
from tabfold.workspace import stage

BAND = 32
#: Turns of a conversation that are summed, or joined, as one group.
BLOCK = 1024
#: Ids of a piece of a list.
PIECE = 512

#: Conversations that share the beginnings of one, and how long these may be. Fixed values.
SIBLINGS = 100
LONGEST_START = 6

NODE = ["depth", "a", "b"]


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``conv, pos, role, digest, points``: turns numbered from 1 by ``turn``, null first.

    A null role or text is empty.  Equal turn numbers are ordered by role and then by the MD5 of the text.  Rows without
    a conversation are left out; ids are whole numbers.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"),
        F.length(text).cast("long").alias("points"),
    )
    rows = rows.withColumn("order", F.struct("conv", "turn", "role", "digest"))
    return rank_by_value(rows, ["conv"], "order", name="pos").select("conv", F.col("pos").cast("long"), "role", "digest", "points")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and ``conv, total`` of all, those without a turn included.

    With ``h`` the checksum of the decimal id modulo ``LONGEST_START``, the first ``h`` turns of the conversation at the
    last multiple of ``SIBLINGS`` replace the first ``h`` of each.
    """
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    start = F.crc32(F.col("conv").cast("string").cast("binary")) % LONGEST_START
    shape = sizes.select("conv", "turns", start.alias("h"), F.expr(f"conv - conv % {SIBLINGS}").alias("source"))
    sources = sizes.select(F.col("conv").alias("source"), F.col("turns").alias("there"))
    shape = shape.join(sources, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    shape = stage(shape.drop("there"), "shape")
    lent = turns.where(f"pos < {LONGEST_START} AND conv % {SIBLINGS} = 0").withColumnRenamed("conv", "source")
    borrowed = shape.where("taken > 0").select("conv", "source", "taken").join(lent, "source").where("pos <= taken")
    # one row of the shape for each block of turns, so a conversation of any length is joined in pieces
    blocks = shape.select("conv", "h", "taken", F.explode(F.expr(f"sequence(0L, turns div {BLOCK})")).alias("block"))
    own = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv", "block"]).where("pos > h")
    own = own.withColumn("pos", F.expr("pos - h + taken"))
    columns = ["conv", "pos", "role", "digest", "points"]
    totals = shape.select("conv", F.expr("taken + greatest(turns - h, 0)").alias("total"))
    return borrowed.select(columns).unionByName(own.select(columns)), totals


def _paths(turns: DataFrame, totals: DataFrame) -> DataFrame:
    """``conv, depth, a, b, up_a, up_b, points`` of every node on the way of every conversation, the root included."""
    hashed = turns.select(
        "conv",
        "pos",
        "points",
        F.xxhash64("pos", "role", "digest").alias("x"),
        F.xxhash64("digest", "role", "pos").alias("y"),
        F.expr(f"pos div {BLOCK}").alias("block"),
    )
    hashed = stage(hashed, "hashed")
    blocks = hashed.groupBy("conv", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("conv", "block", F.bit_xor("x").over(before).alias("x0"), F.bit_xor("y").over(before).alias("y0")).where("block > 0")
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.withColumn("a", F.bit_xor("x").over(inside)).withColumn("b", F.bit_xor("y").over(inside))
    summed = summed.join(starts, ["conv", "block"], "left")
    named = summed.select(
        "conv",
        F.col("pos").alias("depth"),
        F.expr("a ^ coalesce(x0, 0L)").alias("a"),
        F.expr("b ^ coalesce(y0, 0L)").alias("b"),
        F.expr("a ^ coalesce(x0, 0L) ^ x").alias("up_a"),
        F.expr("b ^ coalesce(y0, 0L) ^ y").alias("up_b"),
        "points",
    )
    nothing = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    roots = totals.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), nothing.alias("up_a"), nothing.alias("up_b"), zero.alias("points"))
    return stage(named.unionByName(roots), "paths")


def _nodes(paths: DataFrame) -> DataFrame:
    nodes = paths.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min("conv").alias("conv_id"),
        F.max("points").alias("points"),
        F.min("up_a").alias("up_a"),
        F.min("up_b").alias("up_b"),
    )
    nodes = stage(nodes, "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    counted = nodes.join(below.agg(F.count(F.lit(1)).alias("n_children")), NODE, "left")
    return stage(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def _lists(paths: DataFrame, nodes: DataFrame, step: int, band: int) -> DataFrame:
    """``depth, a, b, tail, above`` of nodes at multiples of ``step``: their ancestors in the own band of depths.

    A band is ``band`` steps deep.  The first node of a band also appears as the ``tail`` of the band before, with all its
    ancestors there.
    """
    rows = paths.where(F.col("depth") % step == 0).select("conv", *NODE)
    high = step * band
    own = rows.select("*", F.expr(f"depth div {high}").alias("band"), F.lit(False).alias("tail"))
    tails = rows.where(f"depth > 0 AND depth % {high} = 0").select("*", F.expr(f"depth div {high} - 1").alias("band"), F.lit(True).alias("tail"))
    earlier = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    listed = own.unionByName(tails).withColumn("above", F.collect_list(F.struct(*NODE)).over(earlier))
    # the smallest member of a node speaks for it
    first = nodes.select(F.col("conv_id").alias("conv"), "depth")
    return stage(listed.join(first, ["conv", "depth"]).select(*NODE, "tail", "above"), "lists")


def _given(rows: DataFrame, above: Column, values: list[str]) -> DataFrame:
    """Sums of the values that reach each node of ``above``."""
    told = rows.select(F.explode(above).alias("to"), *values)
    return told.groupBy(*[F.col(f"to.{c}").alias(c) for c in NODE]).agg(*[F.sum(v).alias(v) for v in values])


def rollup(paths: DataFrame, nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """The node name and, for each of ``values``, the sum over its subtree, itself included."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    steps = [1]
    while steps[-1] * band <= deepest:
        steps.append(steps[-1] * band)
    lists = [_lists(paths, nodes, step, band) for step in steps]
    inside, carried = [], nodes.select(*NODE, *values)
    for step, listed in zip(steps, lists):
        rows = listed.where("NOT tail").drop("tail").join(carried, NODE)
        own = F.array_append("above", F.struct(*NODE))
        inside.append(stage(_given(rows, own, values), "inside"))
        carried = inside[-1].where(F.col("depth") % (step * band) == 0)
    whole = inside[-1]
    for local, listed in zip(inside[-2::-1], lists[-2::-1]):
        below = listed.where("tail").drop("tail").join(whole, NODE)
        more = _given(below, F.col("above"), values).select(*NODE, *[F.col(v).alias(f"more_{v}") for v in values])
        sums = [(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]
        whole = stage(local.join(more, NODE, "left").select(*NODE, *sums), "whole")
    return whole


def _hashed_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, which follow one another in order."""
    node, state, done = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["depth"], row["a"], row["b"])
            if key != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(row["piece"].encode())
        yield _hashes(done)
        done = []
    if node is not None:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])


def _ends(paths: DataFrame, totals: DataFrame) -> DataFrame:
    """Digest of the ids that end in a node.

    Ids are joined in pieces of ``PIECE`` inside sampled ranges; only the hash, which has an order, runs over the pieces of a node.
    """
    last = totals.select("conv", F.col("total").alias("depth"))
    ends = paths.join(last, ["conv", "depth"]).select("conv", *NODE)
    ranges = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(ranges, "conv").withColumn("part", F.spark_partition_id())
    numbered = ranged.withColumn("piece", F.expr(f"(row_number() OVER (PARTITION BY depth, a, b, part ORDER BY conv) - 1) div {PIECE}"))
    pieces = numbered.groupBy(*NODE, "part", "piece").agg(F.min("conv").alias("first"), F.sort_array(F.collect_list("conv")).alias("ids"))
    pieces = pieces.select(*NODE, "first", F.expr("array_join(transform(ids, x -> string(x)), ',')").alias("piece"))
    sorted_pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return sorted_pieces.mapInArrow(_hashed_lists, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, totals: DataFrame, band: int = BAND) -> DataFrame:
    """A row for every distinct beginning of the conversations in ``totals`` (``conv, total``).

    ``turns`` has ``conv, pos, role, digest, points`` with positions from 1 without gaps.  Returned are ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``.  No conversations give no rows.
    """
    paths = _paths(turns, totals)
    nodes = _nodes(paths)
    valued = nodes.select(
        "*",
        F.expr("IF(n_children = 0, 1L, 0L)").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"),
    )
    sums = rollup(paths, valued, ["n_leaves", "saved_tokens"], band)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    below = nodes.where("depth > 0").select(*NODE, "up_a", "up_b")
    parents = join_popular(below, up, ["depth", "up_a", "up_b"], popular(F.col("siblings"), nodes.count()))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return (
        nodes.join(sums, NODE)
        .join(parents.select(*NODE, "parent_conv_id"), NODE, "left")
        .join(_ends(paths, totals), NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    )


def shared_beginnings(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations; see ``ordered_turns`` for nulls, ties and repeated rows."""
    turns = stage(ordered_turns(conversations), "turns")
    made, totals = rebuilt(turns)
    return prefix_trie(made, totals, band)


def shared_beginnings_sql() -> str:
    """DuckDB SQL of ``shared_beginnings`` over ``conversations``; prefixes are compared whole, as lists of MD5 texts."""
    return f"""
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
    SELECT c, c - c % {SIBLINGS} AS source, {duck.crc32("name")} % {LONGEST_START} AS h
    FROM (SELECT DISTINCT c, c::VARCHAR AS name FROM turns), {duck.CRC_TABLE}),
made AS (
    SELECT i.c, 0 AS part, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.c = i.source AND t.pos <= i.h
    UNION ALL SELECT i.c, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.c = i.c AND t.pos > i.h),
placed AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, md5(role) || md5(text) AS turn, length(text) AS points
    FROM made),
paths AS (
    SELECT c, depth, string_agg(turn, '') OVER (PARTITION BY c ORDER BY depth) AS key, points FROM placed
    UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT depth, key, count(*) AS n_convs, min(c) AS conv_id, max(points) AS points FROM paths GROUP BY depth, key),
lengths AS (SELECT c, max(depth) AS total FROM paths GROUP BY c),
ends AS (
    SELECT p.depth, p.key, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS list
    FROM paths p JOIN lengths l ON l.c = p.c AND l.total = p.depth GROUP BY p.depth, p.key),
children AS (SELECT depth - 1 AS depth, left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
valued AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k USING (depth, key)),
told AS (
    SELECT d AS depth, left(key, 64 * d) AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
           sum((n_convs - 1) * points)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY 1, 2)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children,
       t.n_leaves, t.saved_tokens, sha256(coalesce(e.list, '')) AS ends_sha256
FROM valued v JOIN told t USING (depth, key)
LEFT JOIN ends e USING (depth, key)
LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.key = left(v.key, 64 * (v.depth - 1))
"""
