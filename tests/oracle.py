"""Comparison of a Spark result with its SQL equal."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def _kind(name):
    name = name.lower()
    for kind, words in {
        "int": ("bigint", "integer", "int", "hugeint", "long", "smallint"),
        "real": ("double", "float"),
        "text": ("varchar", "string"),
        "bool": ("boolean",),
    }.items():
        if name in words:
            return kind
    return name


def compare(df, con, sql):
    """Raises when columns, kinds, row counts or values differ."""
    names = sorted(df.columns)
    result = con.execute(sql)
    header = [d[0] for d in result.description]
    kinds = {d[0]: _kind(str(d[1])) for d in result.description}
    theirs = result.fetchall()
    assert names == sorted(header), (names, sorted(header))
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    assert mine == kinds, (mine, kinds)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    left = sorted(tuple(_cell(v) for v in r) for r in rows)
    order = [header.index(n) for n in names]
    right = sorted(tuple(_cell(r[i]) for i in order) for r in theirs)
    assert len(left) == len(right), (len(left), len(right))
    for a, b in zip(left, right):
        assert a == b, (a, b)
    return len(left)
