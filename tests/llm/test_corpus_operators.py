"""Duplicates, contamination, licences, urls, shards and the pipeline against brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabfold.llm import decontam, licenses, queries, sharding, sketches, suffix, urls
from tabfold.llm.components import components
from tests.oracle import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SMALL = "/root/testdata/sf0.001"


def _docs(spark, texts, ids=None):
    rows = [(i, t, "kept", 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, k1 int, spans int").repartition(3)


# --- repeated byte strings


def _covered(texts, length):
    counts = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if counts[t[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        out.append(bytes(mask))
    return out


@pytest.mark.parametrize("group", [5000, 1])
def test_repeats_equal_brute_force(spark, group):
    rng = random.Random(5)
    passages = ["".join(rng.choice("ab c") for _ in range(rng.randrange(20, 80))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(40))) for _ in range(5)]
        texts.append("".join(parts))
    texts += [None, "", "x" * 300, "ab" * 200, texts[0], texts[0] + "!"]
    found = suffix.remove_repeats(_docs(spark, texts), length=30, gram=8, whole_group=group).collect()
    assert len(found) == len(texts) and found[0]["row"] == "kept" and found[0]["k1"] == 1
    raw = [(t or "").encode() for t in texts]
    masks = _covered(raw, 30)
    for r in found:
        data, mask = raw[r["doc_id"]], masks[r["doc_id"]]
        assert bytes(r["kept_text"]) == bytes(c for c, m in zip(data, mask) if not m), r["doc_id"]
        edges = [m.span() for m in re.finditer(b"\1+", mask)]
        assert [(s["start"], s["stop"]) for s in r["removed_spans"]] == edges


def test_repeats_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    masks = _covered([t for _, t in rows], 400)
    found = {r["doc_id"]: r for r in suffix.digests(docs).collect()}
    assert any(any(m) for m in masks)
    for (key, text), mask in zip(rows, masks):
        kept = bytes(c for c, m in zip(text, mask) if not m)
        expected = (len(text), sum(mask), len(re.findall(b"\1+", mask)), hashlib.sha256(kept).hexdigest())
        own = found[key]
        assert (own["n_bytes"], own["n_removed"], own["n_spans"], own["kept_sha256"]) == expected


def test_a_context_of_many_documents_is_not_shuffled_by_its_key(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    notice = word(120)
    texts = [f"{word(25)} {notice} {word(25)}" for _ in range(300)]
    texts += [f"{word(25)} {notice[:60]}{notice[61:]} {word(25)}" for _ in range(3)] + [word(90) for _ in range(30)]
    hot = []
    inner = suffix.join_popular

    def spy(left, right, on, is_popular):
        rest = right.where(~is_popular).select(*on)
        hot.append((on, left.join(rest, on).groupBy(*on).count().agg({"count": "max"}).first()[0] or 0))
        return inner(left, right, on, is_popular)

    monkeypatch.setattr(suffix, "join_popular", spy)
    found = suffix.remove_repeats(_docs(spark, texts), length=30, gram=8).collect()
    assert [on for on, _ in hot] == [["gram"], ["gram", "context"]] and all(most < 50 for _, most in hot)
    raw = [t.encode() for t in texts]
    masks = _covered(raw, 30)
    for r in found:
        assert bytes(r["kept_text"]) == bytes(c for c, m in zip(raw[r["doc_id"]], masks[r["doc_id"]]) if not m)


def test_repeats_cut_at_whole_code_points_and_repeated_rows(spark):
    core = "é" * 40
    docs = _docs(spark, ["1" + core + "2", "3" + core + "4", "lone", "twice" * 9, "twice" * 9], [0, 1, 2, 3, 3])
    found = suffix.remove_repeats(docs, length=31, gram=8, whole_points=True).collect()
    texts = {r["doc_id"]: bytes(r["kept_text"]).decode() for r in found}
    assert len(found) == 5 and texts[2] == "lone" and texts[3] == "" and texts[0] == "12"
    assert suffix.remove_repeats(docs.limit(0)).count() == 0
    null_ids = suffix.remove_repeats(_docs(spark, ["a" * 50, "a" * 50], [None, None]), length=31, gram=8).collect()
    assert [bytes(r["kept_text"]) for r in null_ids] == [b"", b""]


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffix.multikey_quicksort(keys)
    assert sorted(map(tuple, keys.tolist())) == [tuple(keys[i].tolist()) for i in order]


# --- near duplicates


def _sets(texts, size):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        out.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, min(len(w), 1)))})
    return out


def _groups(sets, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(400))
    line = [word() for _ in range(12)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 200))] + line
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].lower(), None, "", " \t", "one two", "ONE two", "one", "one two three", "é " * 3000]
    found = {r["doc_id"]: r for r in sketches.near_duplicates(_docs(spark, texts), 4).collect()}
    sets, ids = _sets(texts, 4), list(range(len(texts)))
    expected = _groups(sets, ids)
    assert len(found) == len(texts)
    for i in ids:
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(sets[i]), expected[i], expected[i] == i)


def test_near_duplicates_of_a_chain_and_a_large_group(spark):
    """Neighbours in a chain are near, its ends are not; the group is larger than a block."""
    words = [f"w{i}" for i in range(160)]
    chain = [" ".join(words[: 100 + 10 * k][10 * k :]) for k in range(6)]
    base = [f"b{i}" for i in range(120)]
    group = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(120)]
    before = sketches.BLOCK
    sketches.BLOCK = 50
    try:
        texts = chain + group
        found = {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(_docs(spark, texts), 4).collect()}
    finally:
        sketches.BLOCK = before
    assert found == _groups(_sets(texts, 4), list(range(len(texts))))


def test_near_duplicates_of_odd_rows(spark):
    docs = _docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 7, 7, 8])
    found = sketches.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (7, 7, True), (7, 7, True), (8, 8, True)]
    assert sketches.near_duplicates(docs.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    assert found == {n: root(n) for n in parent}
    assert components(frame.limit(0)).count() == 0


# --- contamination

ITEM = "In the year 1987 Anna Keller drove 120 km from Bern to the lake with 3 friends and 12 apples. How long did it take?"
OTHER = "In the year 2003 Marta Lopez drove 75 km from Rome to the lake with 5 friends and 40 apples. How long did it take?"
BROKEN = "In the year 2003 Marta Lopez drove 75 km from Rome to the lake with 75 friends and 75 apples. How long did it take?"


def test_templates():
    assert decontam.WINDOW <= decontam.RUN


def test_leaks_verbatim_and_with_other_values(spark):
    docs = _docs(
        spark,
        [f"Some words before. {ITEM} And after.", f"Before. {OTHER}", f"Before. {BROKEN}", "In the year of the lake nothing leaks here at all.", None, "", ITEM.lower().replace(" ", "\n")],
    )
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, ITEM)], "item_id long, text string")
    leaked = decontam.leaks(docs, items)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    assert compare(leaked, con, decontam.leaks_sql()) >= 4
    found = {(r["doc_id"], r["item_id"]): r for r in leaked.collect()}
    assert set(found) >= {(0, 1), (0, 5), (1, 1), (1, 5)}
    assert not {k for k in found if k[0] in (2, 3, 4, 5)}
    assert found[0, 1]["verbatim"] and not found[1, 1]["verbatim"] and found[1, 1]["n_slots"] > 0
    kept = decontam.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {2, 3, 4, 5}
    assert decontam.leaks(docs.limit(0), items).count() == 0
    assert decontam.leaks(docs, items.limit(0)).count() == 0
    assert decontam.drop_leaks(docs, items.limit(0)).count() == 7


def test_leaks_beyond_the_broadcast_bound(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    expected = sorted(map(tuple, decontam.leaks(docs, items).collect()))
    before = decontam.BROADCAST_WINDOWS
    decontam.BROADCAST_WINDOWS = 0
    try:
        assert sorted(map(tuple, decontam.leaks(docs, items).collect())) == expected
    finally:
        decontam.BROADCAST_WINDOWS = before


def test_short_and_number_rich_items(spark):
    items = [
        (1, "What is the capital of Australia?"),
        (2, "Find the mean of 12, 15, 18, 21, 24, 27, 30, 33, 36 and 39."),
        (3, "Ann has 3 apples and 12 pears, so how many fruits does she hold in both hands?"),
        (4, "Yes of course."),
        (5, "Name the longest river that crosses three borders."),
    ]
    docs = [
        (1, "We asked them: what is the capital of Australia? Nobody knew it at that time."),
        (2, "What is the capital of Australia"),
        (3, "what is the capital of Austria? It is a city with a long past."),
        (4, "Exercise one. Find the mean of 12, 15, 18, 21, 24, 27, 30, 33, 36 and 39. Then rest."),
        (5, "Numbers: 12, 15, 18, 21, 24, 27, 30, 34, 37, 40, 43 and 46 in a row."),
        (6, "Ann has 5 apples and 5 pears, so how many fruits does she hold in both hands?"),
        (7, "She said yes of course. And went."),
        (8, "Yes, of course!"),
        (9, "then Name the longest river that crosses three borders."),
        (10, None),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    leaked = decontam.leaks(docs, items)
    found = {(r["doc_id"], r["item_id"]) for r in leaked.collect()}
    assert found == {(1, 1), (2, 1), (4, 2), (6, 3), (8, 4), (9, 5)}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    assert compare(leaked, con, decontam.leaks_sql()) == len(found)


def test_few_documents_are_looked_at_and_no_leak_is_lost(spark, monkeypatch):
    plain = "the river runs past an old mill where people met in spring and talked about the harvest of that year"
    items = [
        (1, ITEM),
        (2, "Why did ΟΔΟΣ. come (so late) to town that night?"),
        (3, "... ... ... !!! ?"),
        (4, "Add 1 2 then 3 4 or 5 6 also 7 8 up."),
        (5, "a.b.c.d.e f.g"),
        (6, "Of the Anna in the Berta or the Carla by the Dora with the Emma."),
    ]
    docs = [
        (1, f"{plain} {ITEM}"),
        (2, f"{plain}. Why did οδος. come (so late) to town that night?"),
        (3, f"{plain}\n... ... ...\t!!! ? {plain}"),
        (4, f"{plain}. Add 1 2 then 3 4 or 5 6 also 7 8 up."),
        (5, "A.b.c.d.e f.g."),
        (6, "Of the Xenia in the Ylva or the Zora by the Wanda with the Vera."),
        (7, f"{plain} " + "." * 200_000 + "x"),
        (None, OTHER),
        (9, ITEM[: len(ITEM) // 2]),
        (9, f"{plain} {ITEM[len(ITEM) // 3 :]}"),
        *[(i, f"{plain} {i}") for i in range(10, 60)],
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    looked_at = []
    inner = decontam._suspects
    monkeypatch.setattr(decontam, "_suspects", lambda *a: looked_at.append(inner(*a)) or looked_at[-1])
    for own in (items, [r for r in items if r[0] != 3]):  # the third is in every text, as far as tokens tell
        bench = spark.createDataFrame(own, "item_id long, text string")
        leaked = decontam.leaks(docs, bench)
        con = duckdb.connect()
        con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
        con.register("benchmark", bench.toPandas())
        assert compare(leaked, con, decontam.leaks_sql()) >= 5
        found = {(r["doc_id"], r["item_id"]) for r in leaked.collect()}
        assert {(1, 1), (4, 4), (5, 5), (6, 6), (None, 1), (9, 1)} <= found and ((3, 3) in found) == (len(own) == 6)
    assert looked_at[0].count() == docs.count() and looked_at[1].count() < 12


def test_leaks_hold_all_items_found_as_text(spark):
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    expected = {(i, r["item_id"]) for r in items.collect() for i, t in texts.items() if r["text"] in t}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert expected and expected <= found and len(found - expected) <= len(expected) // 10


# --- licences


def test_licences_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "plain words"),
        (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0 (the License);\ncode code"),
        (4, "z/q.py", "nothing"),
        (5, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "a/b/c/d/w.py", None),
        (7, None, "a word"),
        (8, "top", "driving licence tests are hard for many people"),
        (8, "top", "driving licence tests are hard for many people"),
        (None, "a/n.py", ""),
    ]
    files = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, path string, text string, unit int")
    found = {r["doc_id"]: (r["license"], r["scope"]) for r in licenses.scan(files).collect()}
    assert licenses.scan(files).count() == 10
    assert found[1] == ("MIT", "own") and found[3] == ("Apache-2.0", "own") and found[5] == ("GPL-3.0", "own")
    assert found[2] == ("GPL-3.0", "inherited") and found[6] == ("GPL-3.0", "inherited")
    assert found[None] == ("MIT", "inherited")
    assert found[4] == found[7] == found[8] == (None, "none")
    assert licenses.scan(files.limit(0)).count() == 0


def test_licences_of_documents(spark):
    found = {r["doc_id"]: r for r in queries.op5_licenses(spark, FOLDER).collect()}
    names = {"MIT License": "MIT", "CC BY-NC 4.0": "CC-BY-NC-4.0", "Apache License, Version 2.0": "Apache-2.0", "General Public License, version 3": "GPL-3.0"}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        held = {v for k, v in names.items() if k in (r["text"] or "")}
        if held:
            assert found[r["doc_id"]]["scope"] == "own" and found[r["doc_id"]]["license"] in held


# --- urls


def test_url_parts_and_rules(spark):
    rows = [
        (0, "http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (1, "https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        (2, "https://a.com", "a.com", "", None, "allow"),
        (3, "https://a.net?q=/es/", "a.net", "", None, "allow"),
        (4, "x://a.net/es/#f", "a.net", "/es/", "net/es/", "block"),
        (5, "nothing", "", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (7, "http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, None, "h", "v") for i, u, *_ in rows], "page_id long, url string, html string, host string, verdict string")
    found = urls.judge(pages, urls.links(pages), queries.URL_RULES).collect()
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found)
    assert got == sorted((i, h, p, r or "", v) for i, _, h, p, r, v in rows)
    assert urls.judge(pages.limit(0), urls.links(pages.limit(0)), queries.URL_RULES).count() == 0


def test_blocks_travel_to_aliases_unless_allowed(spark):
    canonical = '<html><LINK href="{}" rel="canonical"></html>'
    refresh = '<meta http-equiv=refresh content="0; url={}">'
    rows = [
        (0, "http://free.org/1", canonical.format("http://bad.net/es/1")),
        (1, "http://free.org/2", refresh.format("/1")),
        (2, "http://free.org/3", canonical.format("https://fine.com/x")),
        (3, "https://fine.com/x", canonical.format("http://bad.net/fr/")),
        (4, "http://free.org/4", "<p>no link</p>"),
        (5, "http://free.org/2", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = urls.judge(pages, urls.links(pages), queries.URL_RULES)
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert compare(judged, con, urls.judge_sql(queries.URL_RULES)) == len(rows)
    assert found == {0: (None, "block"), 1: (None, "block"), 2: (None, "allow"), 3: ("com/", "allow"), 4: (None, "allow"), 5: (None, "block")}


def test_links_of_every_kind_reach_their_pages(spark):
    bad = '<link rel="canonical" href="http://bad.net/es/{}">'
    rows = [
        (0, "http://a.org/x", """<meta http-equiv="refresh" content="0; url='http://b.org/y'">"""),
        (1, "http://b.org/y", bad.format(1)),
        (2, "http://a.org/dir/p.html?n=1", '<link rel=canonical href="q.html">'),
        (3, "http://a.org/dir/q.html", bad.format(2)),
        (4, "http://c.org/s", '<link rel=canonical href="http://c.org/s"><link rel=canonical href="../t?u=1&amp;v=2#w">'),
        (5, "HTTP://C.org/./a/../t?u=1&v=2#f", bad.format(3)),
        (6, "http://d.org", '<link rel="canonical" href="?p=2"><link rel="canonical" href="mailto:x">'),
        (7, "http://d.org/?p=2", bad.format(4)),
        (8, "http://D.ORG/#f", "<p>none</p>"),
        (9, "http://e.org/1", '<link rel="canonical" href="#top">'),
        (10, None, bad.format(5)),
        (11, "no scheme", bad.format(6)),
        (12, "http://f.org/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = urls.judge(pages, urls.links(pages), queries.URL_RULES)
    assert {r["page_id"] for r in judged.collect() if r["verdict"] == "block"} == {*range(9)}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert compare(judged, con, urls.judge_sql(queries.URL_RULES)) == len(rows)


# --- shards


def _jump(key, shards):
    b, j, state = -1, 0, key % (1 << 64)
    while j < shards:
        b = j
        state = (state * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((state >> 33) + 1)))
    return b


def test_jump_equals_the_plain_loop_and_moves_little():
    keys = np.array([0, 1, -5, 2**62, *range(10, 3000)], np.int64)
    for shards in (1, 2, 16, 17):
        assert sharding.jump(keys, shards).tolist() == [_jump(int(k), shards) for k in keys]
    before, after = sharding.jump(keys, 16), sharding.jump(keys, 17)
    assert set(after[before != after]) == {16} and np.mean(before != after) < 2 / 17


def test_slots_are_gapless_in_key_order(spark):
    docs = spark.createDataFrame([(i, "é" * (i % 5) if i and i % 7 else None, 1, 2) for i in [*range(500), 3, 3, None]], "doc_id long, text string, shard int, part int")
    found = sharding.assign(docs, 16).collect()
    assert len(found) == 503
    for shard in range(16):
        own = sorted((r for r in found if r["shard"] == shard), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert keys == sorted(keys)
    assert all(r["shard"] == _jump(r["doc_id"] or 0, 16) and r["grown_shard"] in (r["shard"], 16) for r in found)
    assert {r["size"] for r in found if r["doc_id"] == 8} == {7} and {r["size"] for r in found if r["doc_id"] == 7} == {1}
    assert sharding.assign(docs.limit(0), 16).count() == 0


# --- the pipeline


def test_pipeline_keeps_clashing_columns_and_one_of_repeated_rows(spark):
    names = ["kept_text", "removed_spans", "kept_id", "kept_lang", "kept_mark", "gone_id", "leaked_id", "row", "all", "n", "mark", "h", "a b"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 5")).withColumns({c: F.lit(f"own {c}") for c in names})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, SMALL)
        assert after.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    rows = docs.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in names)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    early = [r for r in rows if r["doc_id"] < 5]
    assert early and all(r["text"] or not texts[r["doc_id"]] for r in early)


def test_pipeline_removes_shared_passages_of_short_words(spark):
    passage = " ".join("a b cd e fg hi j k lm no".split() * 3 + [f"wo{i}" for i in range(21)])
    assert len(passage.split()) == 51 and 160 <= len(passage) < 250
    near = "this sentence of some forty words is shared and yet it stays " * 3
    rows = [(i, f"first {i} {i * i} {passage} last {i + 7}") for i in range(3)]
    rows += [(i, f"before {i} {near[:200]} after {i * 3}") for i in range(10, 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, SMALL).collect()}
    assert all(passage[:60] not in kept[i] and kept[i].startswith("first") for i in range(3))
    assert all(kept[i] == text for i, text in rows[3:])


def test_pipeline_carries_one_text_through_the_shuffles(spark, monkeypatch):
    inner, seen = suffix.remove_repeats, []

    def spy(docs, **settings):
        seen.append(docs.schema)
        return inner(docs, **settings)

    monkeypatch.setattr(suffix, "remove_repeats", spy)
    docs = spark.createDataFrame([(1, "en", "one text", 8), (2, "de", None, 0)], "doc_id long, lang string, text string, n_chars int")
    after = corpus_pipeline.suffix_dedup(spark, docs, SMALL)
    assert after.dtypes == docs.dtypes
    assert {r["doc_id"]: (r["lang"], r["text"], r["n_chars"]) for r in after.collect()} == {1: ("en", "one text", 8), 2: ("de", "", 0)}
    assert [str(schema).count("'text'") for schema in seen] == [1]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, SMALL)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        assert 0 < after.count() <= docs.count()
        before, docs = docs, spark.createDataFrame(after.collect(), after.schema)
        if name == "near_dedup":
            judged = {r["doc_id"]: r["component_id"] for r in sketches.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {i for i, c in judged.items() if i == c}
            rows = before.collect()
            assert judged == _groups(_sets([r["text"] for r in rows], 5), [r["doc_id"] for r in rows])
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert encoded.count() == docs.count()
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
