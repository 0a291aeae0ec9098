"""License scans by sparse TF-IDF cosine, and inheritance down the folders, with DataFrame functions only.

Units are the sentences and lines of a text that speak of a licence.  Each different unit is compared once
with the templates: terms are weighted by count times log(1 + units / units with the term), where document
frequencies count all units of all texts; only terms of templates need a frequency, any other term is as
good as unseen.  A file without a licence of its own takes that of the nearest folder above it that has a
licence file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tabfold.workspace import stage

COSINE = 0.6
#: Share of a file's words that licence units must have to make it the licence file of its folder.
FILE_SHARE = 0.5
_SPEAKS = r"(?i)licen[cs]|copyright|copyleft|spdx|rights reserved|public domain|creative commons|\bcc[ -]by|\bcc0"
_UNITS = r"(?<=[.!?;])\s+|\s*[\r\n]+\s*"

#: Templates of licence statements. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("ISC", "Released under the ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright All rights reserved"),
]


def _terms(unit: Column) -> Column:
    return F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda t: t != "")


def _units(text: Column) -> Column:
    return F.filter(F.split(text, _UNITS), lambda u: u.rlike(_SPEAKS))


def _weighted(counted: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    """``key, term, w`` with the weight of a term's count."""
    joined = counted.join(F.broadcast(weights), "term", "left")
    return joined.select("key", "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"))


def statements(files: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``unit, license, cosine`` of every different unit of ``files`` (``text``) near enough to a template."""
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    units = files.select(F.explode(_units(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))
    units = stage(units, "units")
    total = units.agg(F.sum("n")).first()[0] or 0
    given = spark.createDataFrame([(str(i), name, text) for i, (name, text) in enumerate(templates)], "key string, license string, text string")
    own = given.select("key", F.explode(_terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    vocabulary = own.select("term").distinct()
    exploded = units.select(F.col("unit").alias("key"), "n", F.explode(_terms(F.col("unit"))).alias("term"))
    counted = exploded.groupBy("key", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    frequency = counted.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weights = vocabulary.join(frequency, "term", "left").select(
        "term", F.log(1 + F.lit(float(total)) / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1))).alias("idf")
    )
    weights = stage(weights, "weights")  # one row a term of the templates
    unseen = math.log(1 + total) or 1.0
    theirs = _weighted(own, weights, unseen)
    norms = theirs.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm_t"))
    theirs = theirs.join(norms, "key").join(given.select("key", "license"), "key")
    theirs = stage(theirs.select(F.col("key").alias("template"), "license", "term", F.col("w").alias("w_t"), "norm_t"), "templates")
    ours = _weighted(counted, weights, unseen)
    length = ours.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = ours.join(F.broadcast(theirs), "term").groupBy("key", "template", "license", "norm_t")
    dots = dots.agg(F.sum(F.col("w") * F.col("w_t")).alias("dot")).join(length, "key")
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("norm_t")), 9)
    near = dots.select("key", "license", cosine.alias("cosine")).where(F.col("cosine") >= COSINE)
    best = near.groupBy("key").agg(F.max("cosine").alias("cosine"), F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license"))
    return best.select(F.col("key").alias("unit"), "license", "cosine")


def _folder(path: Column) -> Column:
    """What stands before the last ``/``, empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def _ancestors(folder: Column) -> Column:
    """The folder and all above it down to the empty one, the nearest first."""
    parts = F.split(folder, "/")
    count = F.when(folder == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), count), lambda k: F.array_join(F.slice(parts, 1, count - k), "/"))


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``id, path, license, cosine, scope`` for every row.

    ``scope`` is ``own`` where a unit of the text matches (the nearest template, ties by name), ``inherited``
    where the nearest folder with a licence file gives it, else ``none`` with a null licence.  A licence file
    is a file whose matching units hold at least ``FILE_SHARE`` of its words; of several in a folder the nearest
    to a template counts.  Null texts have no units; a null path is in no folder.
    """
    rows = files.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.col(path_col).cast("string").alias("path"),
        F.col(text_col).cast("string").alias("text"),
    )
    wordy = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    spoken = rows.select("row", "id", "path", _units(F.col("text")).alias("units"), wordy.alias("size"))
    spoken = stage(spoken, "spoken")
    said = statements(rows)
    each = spoken.where(F.size("units") > 0).select("row", "path", "size", F.explode("units").alias("unit")).join(said, "unit")
    share = F.size(F.filter(F.split("unit", r"\s+"), lambda w: w != ""))
    own = each.groupBy("row", "path", "size").agg(
        F.max("cosine").alias("cosine"),
        F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license"),
        F.sum(share).alias("spoken"),
    )
    own = stage(own, "own")
    texts = own.where((F.col("spoken") >= F.col("size") * FILE_SHARE) & F.col("path").isNotNull())
    best = F.min_by("license", F.struct(-F.col("cosine"), "license"))
    folders = texts.groupBy(_folder(F.col("path")).alias("above")).agg(best.alias("from_above"))
    # the folders, not the files, look upwards
    inner = spoken.where("path IS NOT NULL").select(_folder(F.col("path")).alias("folder")).distinct()
    upward = inner.select("folder", F.posexplode(_ancestors(F.col("folder"))).alias("steps", "above")).join(folders, "above")
    nearest = upward.groupBy("folder").agg(F.min_by("from_above", "steps").alias("inherited"))
    out = spoken.select("row", "id", "path", _folder(F.col("path")).alias("folder"))
    out = out.join(own.select("row", "license", "cosine"), "row", "left").join(nearest, "folder", "left")
    scope = F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("license", "inherited").alias("license"), "cosine", scope.alias("scope")
    )
