"""Connected components by label joins, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabfold.workspace import stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge, ``component`` being the smallest node reachable.

    Each round hooks the label of a node, and of the label itself, to the smallest label next to it, and
    then follows labels twice; labels only fall, so the rounds end, in about the logarithm of the longest
    path.  Minima are combined before the shuffle, so a node with many edges is no large group.  Edges
    with a null end are left out; repeated and self edges are allowed; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct()
    both = stage(both, "edges")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = stage(labels.select(F.col("a").alias("node"), "label"), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("own"))
        seen = both.join(of_b, "b").join(of_a, "a")
        # the node and its present label both learn of the neighbour's label
        told = seen.select(F.explode(F.array("a", "own")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(told, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        hooked = stage(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        jumped = hooked.join(up, "label").select("node", "old", F.col("higher").alias("label"))
        jumped = stage(jumped, "labels")
        changed = jumped.where("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
