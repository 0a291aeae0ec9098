"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; the sketch of a document is its ``SKETCH`` smallest.  Inverted lists
of the ``LISTED`` smallest values bring candidates together, the sketch of a pair's union estimates their
similarity, and exact Jaccard similarity of the whole shingle sets decides.

Lists can be hot, so pairs of a list are never all made:

* equal sets are one class, compared once;
* a class that shares few of its ``CHECKED`` smallest values with any other class can't be near one;
* in every list the classes are first compared with its most central class only (the one whose values
  are the most frequent); confirmed links join classes into components;
* what is left are lists with classes of several components.  They are read in blocks of at most
  ``BLOCK`` classes, where pairs of different components with near enough union sketches are compared on
  whole sets; only links leave the task.

A pair as similar as the limit, 0.8, is missed if its union's smallest values are nearly all unshared: below
0.2 ** 12 for the lists, 1e-8 for the checks and 1e-9 for the estimate.  Below that limit nothing is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tabfold.llm.arrays import flat, mix, short_batches, slices, words
from tabfold.llm.components import components
from tabfold.workspace import stage

WORDS = 5
PERCENT = 80
SKETCH = 64
CHECKED = 24
SHARED = 7
LISTED = 12
ESTIMATE = 0.5
BLOCK = 2048
PAD = np.int64((1 << 63) - 1)
#: Odd factor that makes a shingle's hash depend on the order of its words. Fixed value.
TURN = 0xD6E8FEB86659FD93


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all runs of ``size`` words (all words of a shorter text) and ``texts + 1`` offsets."""
    text, _, _, word = words(data, offsets)
    count = len(offsets) - 1
    per_text = np.bincount(text, minlength=count) if len(text) else np.zeros(count, np.int64)
    first = np.cumsum(per_text) - per_text
    runs = np.where(per_text >= size, per_text - size + 1, (per_text > 0).astype(np.int64))
    ends = np.zeros(count + 1, np.int64)
    np.cumsum(runs, out=ends[1:])
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], runs)
    length = np.repeat(np.minimum(per_text, size), runs)
    out = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            more = np.flatnonzero(length > i)
            out[more] = out[more] * np.uint64(TURN) + word[at[more] + i]
    return (mix(out) >> np.uint64(1)).astype(np.int64), ends


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    data = np.frombuffer(text, np.uint8)
    return np.unique(shingle_hashes(data, np.array([0, len(data)]), size)[0])


def sketch_docs(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, s1, s2, sketch``: set size, 128-bit digest of the set, smallest hashes in order."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, ends = shingle_hashes(*flat(batch.column("text")), size)
            sizes, one, two, sketches = [], [], [], []
            for a, b in zip(ends.tolist(), ends[1:].tolist()):
                found = np.unique(hashes[a:b])
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                sizes.append(len(found))
                one.append(digest[0])
                two.append(digest[1])
                sketches.append(found[:SKETCH])
            stops = np.zeros(len(sketches) + 1, np.int32)
            np.cumsum([len(s) for s in sketches], out=stops[1:])
            values = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(one, np.int64)),
                    pa.array(np.array(two, np.int64)),
                    pa.ListArray.from_arrays(pa.array(stops), pa.array(values)),
                ],
                ["id", "n", "s1", "s2", "sketch"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {key}, n long, s1 long, s2 long, sketch array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    """Sketches as rows, short ones filled up with PAD."""
    rows = np.full((len(column), SKETCH), PAD)
    offsets = column.offsets.to_numpy()
    counts = np.diff(offsets)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    owner = np.repeat(np.arange(len(column)), counts)
    rows[owner, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], counts)] = values
    return rows


def estimates(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches: shared values among the smallest of their union."""
    both = np.sort(np.concatenate([one, other], axis=1), axis=1)
    real = both != PAD
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, axis=1)
    hits = (again & (rank <= SKETCH)).sum(axis=1)
    return hits / np.maximum(np.minimum(rank[:, -1], SKETCH), 1)


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _first_shared(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest value that pairs of sketches share among their listed ones."""
    both = np.sort(np.concatenate([one[:, :LISTED], other[:, :LISTED]], axis=1), axis=1)
    again = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    return np.where(again.any(axis=1), both[np.arange(len(both)), again.argmax(axis=1)], PAD)


def _near_pairs(sketch: np.ndarray, component: np.ndarray, n: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that may be similar enough, in the list of ``value``.

    A pair that shares several lists belongs to the one with the smallest value.  Rows that share too few values with the others of the block go first, until nothing changes: in a list
    kept together by one common passage that is nearly all of them.
    """
    need = np.ceil(ESTIMATE * np.minimum((sketch != PAD).sum(axis=1), SKETCH))
    alive = np.arange(len(sketch))
    while len(alive):
        values, inverse, counts = np.unique(sketch[alive], return_inverse=True, return_counts=True)
        shared = (counts > 1) & (values != PAD)
        ties = shared[inverse.reshape(len(alive), -1)].sum(axis=1)
        stay = ties >= need[alive] * 0.8
        if stay.all():
            break
        alive = alive[stay]
    firsts, seconds = [], []
    for i in range(len(alive) - 1):
        a, rest = alive[i], alive[i + 1 :]
        rest = rest[(component[rest] != component[a]) & _fits(n[rest], n[a])]
        for start in range(0, len(rest), 1024):
            part = rest[start : start + 1024]
            mine = np.broadcast_to(sketch[a], (len(part), SKETCH))
            part = part[_first_shared(mine, sketch[part]) == value]
            near = part[estimates(mine[: len(part)], sketch[part]) >= ESTIMATE]
            firsts.append(np.full(len(near), a))
            seconds.append(near)
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(seconds)


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text"):
            data, offsets = flat(batch.column("text"))
            raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
            packed = pa.array([shrink(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed], ["id", "packed"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"id {key}, packed binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough."""
    of_a = texts.select(F.col("id").alias("a"), F.col("packed").alias("pa"))
    of_b = texts.select(F.col("id").alias("b"), F.col("packed").alias("pb"))
    both = pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = np.zeros(0, np.int64), None
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("pa"), batch.column("pb")):
                blob = one.as_py()
                if blob != last:
                    known, last = shingle_set(zstandard.decompress(blob), size), blob
                mine = shingle_set(zstandard.decompress(other.as_py()), size)
                common = len(np.intersect1d(known, mine, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(known) + len(mine) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    key = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {key}, b {key}")


def _star_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class with the most central class of each of its lists, if their union sketch allows."""
    centre = F.max(F.struct("score", "id"))
    centres = stage(lists.groupBy("value").agg(centre["id"].alias("b"), F.count("*").alias("m")).where("m > 1"), "centres")
    pairs = lists.join(centres, "value").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    of_a = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    of_b = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    both = both.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = estimates(_matrix(batch.column("sa")), _matrix(batch.column("sb"))) >= ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(near))

    key = classes.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {key}, b {key}")


def _linked(texts: pa.ChunkedArray, a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows that are near enough on whole sets, and that join what earlier ones left apart."""
    sets: dict[int, np.ndarray] = {}
    parent: dict[int, int] = {}

    def whole(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(zstandard.decompress(texts[i].as_py()), size)
        return sets[i]

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    firsts, seconds = [], []
    for i, j in zip(a.tolist(), b.tolist()):
        if root(i) == root(j):
            continue
        one, other = whole(i), whole(j)
        common = len(np.intersect1d(one, other, assume_unique=True))
        if 100 * common >= PERCENT * (len(one) + len(other) - common):
            parent[root(i)] = root(j)
            firsts.append(i)
            seconds.append(j)
    return np.array(firsts, np.int64), np.array(seconds, np.int64)


def _block_links(lists: DataFrame, classes: DataFrame, found: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links between different components in the lists that have several; a forest of them for each block.

    Candidates stay inside the task that compares them on whole sets; only links come out.
    """
    labelled = lists.select("value", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("value", "id", F.coalesce("component", "id").alias("component"))
    labelled = stage(labelled, "labelled")
    sizes = labelled.groupBy("value").agg(
        F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    sizes = stage(sizes.where("low <> high").select("value", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "sizes")
    open_lists = labelled.join(sizes, "value").join(classes.select("id", "n", "sketch"), "id").join(texts, "id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = open_lists.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "value",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "id",
        F.xxhash64("component").alias("component"),
        "n",
        "sketch",
        "packed",
    )
    key = classes.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sketch = _matrix(table.column("sketch").chunk(0))
        value = table.column("value")[0].as_py()
        a, b = _near_pairs(sketch, table.column("component").to_numpy(), table.column("n").to_numpy(), value)
        a, b = _linked(table.column("packed"), a, b, size)
        ids = table.column("id")
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    return spread.groupBy("value", "i", "j").applyInArrow(run, f"a {key}, b {key}").distinct()


def near_duplicates(docs: DataFrame, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row.

    Words are runs of other signs than ASCII white space, A-Z in lower case; a document's set has its distinct
    runs of ``size`` words, all its words as one run if they are fewer, nothing without words.  Documents with
    ``100 * common >= 80 * union`` are linked; ``component_id`` is the smallest id reachable, and the document
    with that id is kept.  A document without words, or with a null id, is linked with nothing and kept.
    Rows that repeat an id are one node of the graph: all with the smallest id are kept.
    """
    short_batches(docs.sparkSession)
    sketched = stage(sketch_docs(docs, size, id_col, text_col), "sketches")
    usable = sketched.where("n > 0 AND id IS NOT NULL")
    first = usable.groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "sketch")).alias("one"))
    classes = stage(first.select("s1", "s2", "one.*"), "classes")

    values = classes.select("id", "n", F.explode(F.slice("sketch", 1, CHECKED)).alias("value"))
    frequent = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    frequent = stage(frequent, "frequent")
    shared = values.join(frequent, "value").groupBy("id").agg(F.count("*").alias("shared"), F.sum("df").alias("score"))
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * PERCENT / 100))
    able = shared.join(classes.select("id", "n", "sketch"), "id").where(F.col("shared") >= need)
    able = stage(able.select("id", "n", "score", "sketch"), "able")
    lists = able.select("id", "score", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    lists = stage(lists, "lists")

    repeated = usable.groupBy("id").agg((F.count("*") > 1).alias("several"))
    wanted = able.select("id").join(repeated, "id")
    texts = stage(_packed(docs, id_col, text_col).join(wanted, "id"), "texts")
    # only ids that repeat have texts to choose from
    texts = texts.where("NOT several").union(texts.where("several").dropDuplicates(["id"])).select("id", "packed")
    stars = stage(_confirmed(_star_pairs(lists, able), texts, size), "links")
    found = components(stars)
    rest = stage(_block_links(lists, able, found, texts, size), "links")
    found = components(stars.union(rest))

    members = sketched.join(classes.select("s1", "s2", F.col("id").alias("node")), ["s1", "s2"], "left")
    joined = members.join(found, "node", "left")
    lone = F.col("id").isNull() | (F.col("n") == 0)
    component = F.when(lone, F.col("id")).otherwise(F.coalesce("component", "node"))
    out = joined.select("id", "n", component.alias("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
