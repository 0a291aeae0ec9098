"""Spelling variants: words one edit apart, found by states that walk a trie level by level.

The trie is a table of edges (node, label, child).  A node is a prefix that matters: where words part, where
one ends, or where a walk begins; chains without a branch are one edge, so the rounds follow the branchings
on a path and not the length of a word.  A walk is a row (word, rest, node, edits) and a round joins all
walks with the edges of their nodes.

Two words one edit apart share the first or the last half of either.  The trie therefore holds every word
and its mirror image; a walk begins at the middle of its own word, where few words are left, and makes its
edit behind it.  Only the lower halves of the trie are built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabfold.llm import duck
from tabfold.llm.arrays import Rolling, mix
from tabfold.workspace import stage

#: Letters of a word, and the share of occurrences whose spelling is disturbed. Fixed values.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
ONE_IN = 31
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Code points of words worked on at once.
POINTS = 1 << 18
#: Apart from every hash of a word read forwards.
MIRROR = np.uint64(0x6A09E667F3BCC909)


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side: all tables here grow with the vocabulary.

    Spark takes their sizes from compressed files and from before a word becomes many prefixes, a tenth of what they hold.
    """
    return left.join(right.hint("merge"), on, how)


def disturbed_words(docs: DataFrame, fewest_points: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` of every occurrence: runs of letters with A-Z in lower case, some with one code point deleted.

    The deletion follows the checksum of ``<id>:<run>``, so a run is spelled alike all over a document.  Words of
    fewer than ``fewest_points`` code points are left out.  A null text has no words; a null id is empty.
    """
    # a run is looked at from its first letter only, so that a short one is not tried again from each of its letters
    run = f"(?<![{LETTERS}])[{LETTERS}]{{{fewest_points},}}+"
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(run), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    # lower() is quick and right for plain letters and for runs without capitals; other capitals than A-Z stay
    plain = (F.lower("run") == F.col("run")) | (F.octet_length("run") == F.length("run"))
    lowered = F.when(plain, F.lower("run")).otherwise(F.translate("run", CAPITALS, CAPITALS.lower()))
    rows = rows.select("id", lowered.alias("run"))
    rows = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    place = "cast(h % length(run) AS int)"
    cut = F.expr(f"concat(substring(run, 1, {place}), substring(run, {place} + 2))")
    word = F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= fewest_points)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, depth, key, next`` of the prefixes of words and mirrored words from just above the middle on.

    ``key`` is a hash of side and prefix, ``id`` that of the whole word, ``next`` the code point that follows or 0.
    """
    for batch in batches:
        words = batch.column("word").to_pylist()
        sizes = np.array([len(w) for w in words], np.int64)
        at = 0
        while at < len(words):
            ahead = np.cumsum(sizes[at:])
            end = at + max(1, int(np.searchsorted(ahead, POINTS, "right")))
            yield from (_prefix_rows(words[at:end], side) for side in (0, 1))
            at = end


def _prefix_rows(words: list[str], side: int) -> pa.RecordBatch:
    texts = [w[::-1] for w in words] if side else words
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(w) for w in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    first = np.maximum(lengths // 2 - 1, 0)
    counts = lengths - first + 1
    which = np.repeat(np.arange(len(texts)), counts)
    depth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + first[which]
    rolling = Rolling(mix(points.astype(np.uint64)))
    turn = MIRROR if side else np.uint64(0)
    key = rolling.ranges(starts[which], starts[which] + depth) ^ turn
    ident = rolling.ranges(starts, starts + lengths) ^ turn
    follows = np.zeros(len(which), np.int32)
    inner = depth < lengths[which]
    follows[inner] = points[starts[which[inner]] + depth[inner]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ident[which].view(np.int64)),
            pa.array(depth.astype(np.int32)),
            pa.array(key.view(np.int64)),
            pa.array(follows),
            pa.array(depth == (lengths // 2)[which]),
        ],
        ["id", "depth", "key", "next", "begins"],
    )


def _word_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word rows once for each side: ``id, side, text, n``."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        for side in (0, 1):
            texts = [w[::-1] for w in words] if side else words
            lengths = np.array([len(w) for w in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            starts = np.cumsum(lengths) - lengths
            ident = Rolling(mix(points.astype(np.uint64))).ranges(starts, starts + lengths)
            ident = ident ^ (MIRROR if side else np.uint64(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ident.view(np.int64)), pa.array(np.full(len(words), side, np.int8)), pa.array(texts, pa.string()), batch.column("n")],
                ["id", "side", "text", "n"],
            )


def _trie(words: DataFrame, sided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``node, label, child, ends, heads, head, tail, size`` and the walks at their beginnings.

    ``ends`` tells that the child is a word; ``heads`` are the first code points of the child's own edges.
    """
    rows = words.select("word").mapInArrow(_prefixes, "id long, depth int, key long, next int, begins boolean")
    nodes = (
        rows.groupBy("key")
        .agg(F.min("next").alias("low"), F.max("next").alias("high"), F.max("begins").alias("begins"))
        .where("low <> high OR low = 0 OR begins")
        .select("key", (F.col("low") == 0).alias("ends"))
    )
    on_path = _joined(rows.select("id", "depth", "key"), nodes, "key")
    paths = on_path.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "ends"))).alias("path"))
    paths = stage(_joined(paths, sided.select("id", "text"), "id"), "paths")
    step = """transform(sequence(1, size(path) - 1), i -> struct(
        path[i - 1].key AS node,
        substring(text, path[i - 1].depth + 1, path[i].depth - path[i - 1].depth) AS label,
        path[i].key AS child, path[i].ends AS ends))"""
    edges = paths.where("size(path) > 1").select(F.inline(F.expr(step))).distinct()
    edges = stage(edges, "branches")
    first = F.array_join(F.collect_list(F.substring("label", 1, 1)), "")
    heads = edges.groupBy(F.col("node").alias("child")).agg(first.alias("heads"))
    edges = _joined(edges, heads, "child", "left").select(
        "*", F.substring("label", 1, 1).alias("head"), F.expr("substring(label, 2)").alias("tail"), F.length("label").alias("size")
    )
    edges = stage(edges, "edges")
    middle = "filter(path, x -> x.depth = length(text) div 2)[0]"
    walks = paths.select(
        "id",
        F.expr("substring(text, length(text) div 2 + 1)").alias("rest"),
        F.expr(f"{middle}.key").alias("node"),
        F.lit(0).alias("edits"),
        F.expr(f"{middle}.ends").alias("ends"),
        F.lit(True).alias("live"),
    )
    return edges, walks


#: What a walk may do along an edge: pass it unchanged, or, once, with one code point of the edge replaced, missing from
#: the word, or in excess in the word.  Most edges begin unlike the rest of the word, so the edit is their first code point
#: and what follows must be equal; only the edge that begins alike is compared edit by edit.
_PASSES = "startswith(rest, label)"
_REPLACED = """IF(alike, length(rest) >= size AND levenshtein(substring(rest, 1, size), label, 1) = 1,
    rest <> '' AND substring(rest, 2, size - 1) = tail)"""
_MISSING = """IF(alike, length(rest) >= size - 1 AND levenshtein(substring(rest, 1, size - 1), label, 1) = 1,
    substring(rest, 1, size - 1) = tail)"""
_EXCESS = """IF(alike, length(rest) >= size + 1 AND levenshtein(substring(rest, 1, size + 1), label, 1) = 1,
    substring(rest, 2, size) = label)"""

#: A walk is at a neighbour when a word ends where it is, with its edit made or one code point left over.
_ARRIVED = "ends AND ((edits = 1 AND rest = '') OR (edits = 0 AND length(rest) = 1))"
_LIVE = "heads IS NOT NULL AND (edits = 0 OR (rest <> '' AND contains(heads, substring(rest, 1, 1))))"


def _walk(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """One round: every walk along every edge of its node; those that lead nowhere are dropped."""
    met = _joined(walks.select("id", "rest", "node", "edits"), edges, "node")
    met = met.select("*", F.expr("startswith(rest, head)").alias("alike"), F.expr(_PASSES).alias("passes"))
    met = met.where("passes OR edits = 0")
    # how many code points of the rest are used up, for each move that is possible
    used = F.expr(f"""array(IF(passes, size, NULL), IF(passes, NULL, IF({_REPLACED}, size, NULL)),
        IF(passes, NULL, IF({_MISSING}, size - 1, NULL)), IF(passes, NULL, IF({_EXCESS}, size + 1, NULL)))""")
    moved = met.select("id", "rest", "child", "ends", "heads", F.expr("IF(passes, edits, 1)").alias("edits"), F.explode(used).alias("used"))
    moved = moved.where("used IS NOT NULL").select("id", F.expr("substring(rest, used + 1)").alias("rest"), F.col("child").alias("node"), "edits", "ends", "heads")
    moved = moved.select("id", "rest", "node", "edits", "ends", F.expr(_LIVE).alias("live"))
    return moved.where(f"live OR {_ARRIVED}")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all ordered pairs of ``word`` values that one edit of a code point parts.

    ``words`` has distinct, non-null, non-empty ``word`` and a count ``n``; other columns are ignored.  Nodes
    are named by 64-bit hashes; every pair is compared again by its texts.
    """
    words = words.select("word", "n")
    sided = stage(words.mapInArrow(_word_ids, "id long, side byte, text string, n long"), "sided")
    edges, walks = _trie(words, sided)
    rounds = [stage(walks, "walks")]
    while not rounds[-1].where("live").isEmpty():
        rounds.append(stage(_walk(rounds[-1].where("live"), edges), "walks"))
    pairs = None
    for done in rounds:
        found = done.where(_ARRIVED).select("id", F.col("node").alias("near_id"))
        pairs = found if pairs is None else pairs.unionAll(found)
    ends = sided.select(F.col("id").alias("near_id"), F.col("text").alias("near"), F.col("n").alias("near_n"))
    pairs = _joined(_joined(pairs, ends, "near_id"), sided.select("id", "side", "text"), "id")
    pairs = pairs.where("levenshtein(text, near, 1) = 1")
    # a pair that shares the first half was found there; its mirror image need not count again
    straight = F.reverse("near").startswith(F.expr("substring(reverse(text), 1, length(text) div 2)"))
    pairs = pairs.where((F.col("side") == 0) | ~straight)
    plain = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return pairs.select(plain("text").alias("word"), plain("near").alias("near"), "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` by following ``form`` to the last; each round doubles the steps taken.

    Counts grow from form to form, so there are no rings.
    """
    roots = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = _joined(roots, further, "root", "left")
        roots = stage(further.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.select("word", "root")


def group_variants(
    docs: DataFrame,
    *,
    fewest_points: int = 7,
    fewest: int = 2,
    dominance: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word with ``fewest`` occurrences or more.

    ``form`` is the most frequent near word (the smaller text when equal), if it occurs ``dominance`` times as often;
    ``root`` follows forms to the last and is the word itself without one.  Null and empty texts have no words,
    repeated rows count again, an empty table gives no rows, other columns are ignored.
    """
    occurrences = disturbed_words(docs, fewest_points, id_col, text_col)
    words = occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)
    words = stage(words, "vocabulary")
    near = neighbours(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    judged = _joined(words, best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.expr(f"IF(-best.least >= {int(dominance)} * n, best.near, NULL)").alias("form"),
        F.expr(f"IF(-best.least >= {int(dominance)} * n, -best.least, NULL)").alias("form_n"),
    )
    judged = stage(judged, "forms")
    roots = _roots(judged.where("form IS NOT NULL"))
    return _joined(judged, roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )



def variants_sql(fewest_points: int = 7, fewest: int = 2, dominance: int = 10) -> str:
    """DuckDB SQL of ``group_variants`` over ``documents``.

    Near words have a common text after one deletion, at the same place when they are equally long.
    """
    return f"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id,
           unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS raw FROM documents),
lowered AS (
    SELECT id, translate(raw, '{CAPITALS}', '{CAPITALS.lower()}') AS run FROM runs),
named AS (SELECT id || ':' || run AS name, run, count(*) AS n FROM lowered
    WHERE length(run) >= {fewest_points} GROUP BY 1, 2),
summed AS (SELECT run, n, {duck.crc32("name")} AS h FROM named, {duck.CRC_TABLE}),
spelled AS (
    SELECT CASE WHEN h % {ONE_IN} = 0
           THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
    FROM summed),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= {fewest_points}
    GROUP BY word HAVING sum(n) >= {fewest}),
cuts AS (
    SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS cut
    FROM (SELECT word, unnest(range(0, length(word))) AS k FROM words)),
near AS (
    SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.cut = b.word
    UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.cut = b.word),
ranked AS (
    SELECT near.word, near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
           row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) AS place
    FROM near JOIN words w ON w.word = near.near),
forms AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0)::BIGINT AS n_near,
           CASE WHEN r.near_n >= {dominance} * w.n THEN r.near END AS form,
           CASE WHEN r.near_n >= {dominance} * w.n THEN r.near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
    SELECT word, word AS reached, 0 AS step FROM forms
    UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r USING (word)
"""
