"""Spelling variants, conversation trie and archives against brute force and their SQL."""

import base64
import gzip
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import pytest
from pyspark.sql import functions as F

from tabfold.llm import conversations, queries, spelling, warc
from tabfold.workspace import new_folder
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_spelling_runs_are_whole_and_branches_are_told_by_letters(spark):
    text = "short ABCDEFGH \u00c0BCDEFG stra\u00dfen_Strassen x\u00d7YZabcd 1abcdefg2 \u00e9l\u00e8vesABC " * 3
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    expected = []
    for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text):
        run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
        h = zlib.crc32(f"1:{run}".encode())
        word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
        expected += [word] * (len(word) >= 7)
    assert sorted(r["word"] for r in spelling.disturbed_words(docs, 7).collect()) == sorted(expected)
    words = spark.createDataFrame([(w, 2) for w in ("strasse", "strassen", "strasser", "straszen")], "word string, n long")
    sided = words.mapInArrow(spelling._word_ids, "id long, side byte, text string, n long")
    edges, _ = spelling._trie(words, sided)
    assert dict(edges.dtypes)["heads"] == "string"
    assert {"".join(sorted(r["heads"])) for r in edges.where("ends AND heads IS NOT NULL").collect()} == {"nr"}


@pytest.mark.parametrize("name", ["op11_spelling", "op12_conversation_trie", "op13_warc"])
def test_queries_equal_their_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name])


# --- spelling variants


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark's estimate of staged and exploded tables is far too low, so it must not decide."""
    plans = []
    kept = spelling.stage

    def seen(frame, name):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return kept(frame, name)

    monkeypatch.setattr(spelling, "stage", seen)
    docs = spark.createDataFrame([(i, "gardener " * 9 + "gardeners") for i in range(4)], "doc_id long, text string")
    found = spelling.group_variants(docs, dominance=2)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.where("form IS NOT NULL").count() > 0
    assert not [p for p in plans if "Broadcast" in p] and any("SortMergeJoin" in p for p in plans)


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _words(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(400)}
    words |= {"", "a" * 50, "a" * 51, "a" * 52, "ab" * 40, "ab" * 40 + "a", "ab" * 20 + "b" + "ab" * 20} - {""}
    words |= {"z" * 3000, "z" * 1500 + "y" + "z" * 1500, "z" * 2999, "𝄞abc", "𝄞abd", "𝄞bc"}
    counts = {w: i + 1 for i, w in enumerate(sorted(words))}
    found = [tuple(r) for r in spelling.neighbours(_words(spark, counts)).collect()]
    want = {(a, b, counts[b]) for a in words for b in words if a != b and _one_edit(a, b)}
    assert len(found) == len(set(found)) and set(found) == want


def _variants(rows, fewest_points=7, fewest=2, dominance=10):
    counts = Counter()
    for i, text in rows:
        for run in spelling_runs(text or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= fewest_points:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= fewest}
    near, form = defaultdict(list), {}
    for a in counts:
        near[a] = [b for b in counts if a != b and _one_edit(a, b)]
        if near[a]:
            best = min(near[a], key=lambda b: (-counts[b], b))
            if counts[best] >= dominance * counts[a]:
                form[a] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def spelling_runs(text):
    run = ""
    for c in text + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            run += c.lower() if c.isascii() else c
        elif run:
            yield run
            run = ""


def test_variants_of_odd_rows(spark):
    rng = random.Random(4)
    stems = ["colouring", "colourings", "COLORING", "Straße×÷ñé", "éééééééé", "x" * 400]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(12))) for i in range(300)]
    rows += [(None, "colourings colourings"), (7, None), (8, ""), (9, "short a b"), rows[0], rows[0], (10, "x" * 20000 + " " + "x" * 20000)]
    docs = spark.createDataFrame([(i, t, "n", 1, "w") for i, t in rows], "doc_id long, text string, near string, n int, word string")
    got = [tuple(r) for r in spelling.group_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == _variants(rows)
    texts = docs.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    assert {tuple(r) for r in spelling.group_variants(texts).collect()} == _variants([(None if i is None else f"k{i}", t) for i, t in rows])
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_forms_lead_to_roots(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaacb": 200, "aaaadcb": 2000, "aaaedcb": 19999, "qqqqqqqq": 5}
    text = " ".join(f"{w} " * n for w, n in counts.items())
    # no deletion may touch the counts: take an id under which no word is disturbed
    i = next(i for i in range(10_000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in counts))
    rows = spelling.group_variants(spark.createDataFrame([(i, text)], "doc_id long, text string")).collect()
    assert {r["word"]: r["root"] for r in rows} == {
        "aaaaaaa": "aaaadcb", "aaaaaab": "aaaadcb", "aaaaacb": "aaaadcb", "aaaadcb": "aaaadcb", "aaaedcb": "aaaedcb", "qqqqqqqq": "qqqqqqqq",
    }


# --- conversations


def _trie(rows):
    """``rows``: (conv, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            by[c].append(((turn is not None, turn or 0), role or "", hashlib.md5(text.encode()).hexdigest(), text))
    told = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in by.items()}
    made = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(told.get(c - c % 100, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for key, who in members.items():
        gain = (len(who) - 1) * len(key[-1][1]) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += gain
    return {
        (
            min(who), len(key), min(members[key[:-1]]) if key else None, len(who), children[key], leaves[key], saved[key],
            hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest(),
        )
        for key, who in members.items()
    }


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _found(frame):
    rows = [tuple(r) for r in frame.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("band", [2, 32])
def test_trie_equals_brute_force(spark, band):
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 25), *range(100, 140), 205, 310, 5000]:
        for turn in range(rng.randrange(1, 10)):
            rows.append((c, turn, rng.choice(["user", "bot"]), rng.choice(["", "hi", "héllo", None])))
    rows += [(100, None, None, "first"), (100, 3, "user", "tie"), (None, 0, "user", "lost"), rows[0], rows[0]]
    rows += [(7000, t, "user", "x" * (t % 3)) for t in range(150)] + [(7001, t, "user", "x" * (t % 3)) for t in range(170)]
    table = spark.createDataFrame([(*r, 0, "z") for r in rows], "conv_id long, turn int, role string, text string, depth int, a string").repartition(5)
    assert _found(conversations.shared_beginnings(table, band)) == _trie(rows)
    assert conversations.shared_beginnings(table.limit(0), band).count() == 0


def test_trie_of_many_equal_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 4)
    monkeypatch.setattr(conversations, "PIECE", 3)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 4000, 100) for t in range(3)]
    rows += [(9999, t, "user", f"same {t}" if t < 3 else "on") for t in range(60)]
    table = spark.createDataFrame(rows, "conv_id int, turn long, role string, text string").repartition(7)
    assert _found(conversations.shared_beginnings(table, 3)) == _trie(rows)


# --- archives


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, key string, chunk int").repartition(3)


ODD = [
    (5, "http://a/ b\r\nX: y", "same"),
    (3, None, "same"),
    (9, "http://c/", None),
    (4, "http://d/", ""),
    (None, "http://e/", "same"),
    (8, "http://f/", "WARC/1.1\r\n\r\n" * 3),
    (11, "http://g/", "é" * 5000),
    (10, "http://h/", "é" * 5000),
    (12, "http://i/", "lone"),
    (12, "http://i/", "lone"),
]


def _expected(rows, fewest=0):
    out = Counter()
    groups = defaultdict(list)
    for i, (key, _, html) in enumerate(rows):
        groups[html or ""].append((key is None, key or 0, i))
    for html, who in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min(who)
        for w in who:
            key = None if w[0] else w[1]
            again = w != first and len(data) >= fewest
            out[(key, len(data), digest, "revisit" if again else "response", (None if first[0] else first[1]) if again else None)] += 1
    return out


@pytest.mark.parametrize("fewest", [0, 5])
def test_round_trip_equals_brute_force(spark, fewest, monkeypatch):
    monkeypatch.setattr(warc, "round_trip", partial(warc.round_trip))
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 600)
    got = warc.round_trip(_pages(spark, ODD), fewest_bytes=fewest)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == _expected(ODD, fewest)
    assert warc.round_trip(_pages(spark, ODD).limit(0)).count() == 0


def test_oversized_payloads_are_chunk_rows(spark):
    text = "".join(random.Random(1).choice("abcdé\n") for _ in range(30_000))
    pages = _pages(spark, [(1, "u", text), (2, "v", "tiny")])
    chunks = warc.chunk_table(pages, chunk_bytes=1000)
    parts = chunks.where("key = '1'").orderBy("chunk").collect()
    assert len(parts) == -(-len(text.encode()) // 1000) and all(len(p["data"]) <= 1000 for p in parts)
    assert b"".join(bytes(p["data"]) for p in parts) == text.encode()
    for i, p in enumerate(parts):
        so_far = text.encode()[: 1000 * (i + 1)]
        assert p["bytes_so_far"] == len(so_far) and bytes(p["sha1_so_far"]) == hashlib.sha1(so_far).digest()
    manifest = warc.write_archives(chunks, warc.heads(chunks, "bigint"), new_folder(spark, "warc"))
    back = warc.read_archives(manifest, chunk_bytes=777).where("type = 'response'").orderBy("record_id", "chunk").collect()
    whole = defaultdict(bytes)
    for r in back:
        whole[r["target"]] += bytes(r["data"])
    assert whole == {"u": text.encode(), "v": b"tiny"}


def test_archives_are_plain_warc_files(spark):
    folder = new_folder(spark, "warc")
    manifest = warc.archive_pages(_pages(spark, ODD), folder=folder)
    paths = [r["archive"] for r in manifest.select("archive").distinct().collect()]
    text = b"".join(gzip.decompress(open(p.removeprefix("file:"), "rb").read()) for p in paths)
    assert text.count(b"WARC/1.1\r\nWARC-Type: response") == 5 and text.count(b"\r\nWARC-Type: revisit") == 5
    assert b"WARC-Refers-To: <urn:x-page:" in text and b"\nX: y" not in text
    # a folder without manifest, and an archive that is not compressed
    plain = os.path.join(new_folder(spark, "plain"), "one.warc")
    os.makedirs(os.path.dirname(plain))
    with open(plain, "wb") as f:
        f.write(text)
    want = sorted(map(tuple, warc.read_archives(manifest).where("type <> 'warcinfo'").drop("archive").collect()))
    for place in (folder, os.path.dirname(plain)):
        found = warc.read_archives(warc.archives_in(spark, place)).where("type <> 'warcinfo'").drop("archive").collect()
        assert sorted(map(tuple, found)) == want


def test_broken_archives_are_errors(spark):
    manifest = warc.archive_pages(_pages(spark, ODD))
    with pytest.raises(Exception, match="breaks off|ends inside|no record|incorrect header"):
        warc.read_archives(manifest.withColumn("stop", F.expr("stop - 30"))).count()
    with pytest.raises(Exception, match="no record|ends inside"):
        warc.read_archives(manifest.withColumn("start", F.expr("start + 3"))).count()


def test_copies_of_one_payload_are_spread(spark):
    rows = [(i, f"http://x/{i}", "hot" if i % 3 else f"own {i}") for i in range(3000)]
    got = warc.round_trip(_pages(spark, rows))
    assert Counter(tuple(r) for r in got.collect()) == _expected(rows)
