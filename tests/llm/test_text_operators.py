"""Encoding, language, quality and fingerprints against libraries, brute force and held-out rows."""

import base64
import hashlib
import math
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabfold.llm import bpe, fingerprint, language, ngrams, quality, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
RANKS = queries.RANKS
SIGNS = "ab sS  \n\t'’rveldtm1½٣é中-!? 　\x1c\x85😀"
TEXTS = "doc_id long, text string, lang string, ids string, starts string, n long, id string, row int"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and repeated rows, and columns whose names the operators use themselves."""
    rows = [
        (1, None, None),
        (2, "", "en"),
        (3, " \n\t", "en"),
        (None, "a text without id", "en"),
        (4, "wordé " * 30_000, "en"),
        (5, "same same", "en"),
        (5, "same same", "en"),
        (6, "12 !?", None),
    ]
    return spark.createDataFrame([(*r, "x", "y", 7, "z", 3) for r in rows], TEXTS)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=SIGNS, max_size=120))
def test_ids_are_those_of_the_library(library, text):
    assert bpe.encode_texts([text, text[1:]], bpe.SliceCache(RANKS)) == [
        library.encode_ordinary(text),
        library.encode_ordinary(text[1:]),
    ]


def test_long_slices_merge_alike(library):
    texts = ["a" * 5000, "ab" * 3000, "é" * 400, "x" * 99 + " " + "y" * 101]
    assert bpe.encode_texts(texts, bpe.SliceCache(RANKS)) == [library.encode_ordinary(t) for t in texts]


def test_round_trip_and_offsets(spark, odd, library):
    encoded = bpe.encode(odd, RANKS)
    assert encoded.columns == ["doc_id", "ids", "starts"]
    back = {r["doc_id"]: r for r in bpe.decode(encoded, RANKS).collect()}
    starts = {r["doc_id"]: r["starts"] for r in encoded.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(encoded.collect()) == 8
    for key, text in texts.items():
        assert bytes(back[key]["decoded"]) == text.encode()
        assert list(back[key]["ids"]) == library.encode_ordinary(text)
        pieces = [library.decode_single_token_bytes(i) for i in back[key]["ids"]]
        sizes = np.array([len(p) for p in pieces], np.int64)
        assert starts[key] == (np.cumsum(sizes) - sizes).tolist()
    assert bpe.encode(odd.limit(0), RANKS).count() == 0


def test_digests_of_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = bpe.digests(docs, RANKS).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = language.predictions(docs).collect()
    assert len(found) == len(known)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in known if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_letters_and_marks(spark):
    assert language.normal("नमस्ते") == "नमस्ते" and language.normal("Añn\u0303o 12_x") == "añn\u0303o x"
    assert language.normal("½ ² ③ ⅷ \u0301") == ""
    docs = spark.createDataFrame([(1, "½ ² ③"), (2, "a word")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, {"en": b"a word of some text"}).collect()}
    assert found == {1: "und", 2: "en"}


def test_copies_of_a_text_are_learned_once(spark):
    texts = [f"zeile {chr(97 + i % 26)}{chr(97 + i // 26)} und noch etwas" for i in range(300)]
    rows = [(t, "de") for t in texts] + [("immer dasselbe", "de")] * 2_000
    found = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert len(found["de"].decode().split("\n")) > 250


def test_slices_beyond_the_cache_merge_alike(library, monkeypatch):
    monkeypatch.setattr(bpe, "PLACES", 8)
    monkeypatch.setattr(bpe, "POOL", 40)
    cache = bpe.SliceCache(RANKS)
    texts = ["\0" * 16 + "ab", "", "unaufhaltsamkeitsgesetzgebungsverfahren " * 3, *(f"word{i} drei{i % 5}" for i in range(60))]
    for _ in range(3):
        assert bpe.encode_texts(texts, cache) == [library.encode_ordinary(t) for t in texts]


def test_language_of_odd_rows(spark, odd):
    found = language.identify(odd, {"en": b"some english text", "fr": b"du texte"}).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 8
    for key in (1, 2, 3, 6):
        assert (by_id[key]["lang_pred"], by_id[key]["score"]) == ("und", 0.0)
    assert language.identify(odd.limit(0), {"en": b"x"}).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.identify(odd.where("doc_id = 5"), {"en": b"x"}).first()["score"] == 1.0
    assert language.learn(odd.where("lang IS NULL")) == {}


def test_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("the cat sat on the mat. The dog sat.",), ("a dog and a cat",), (None,), ("",)], "text string")
    model = quality.fit(docs)
    table = np.exp(model.log_table().astype(np.float64)).reshape(-1, quality.SYMBOLS)
    assert np.allclose(table.sum(axis=1), 1.0, atol=2e-3)
    losses = quality.mean_loss(["the cat sat", "xq##!!zz", ""], model)
    assert losses[0] < losses[1] and math.isnan(losses[2])


def test_kneser_ney_by_hand(spark):
    """The probability of one sign, computed from plain counts."""
    texts = ["abab", "abba"]
    model = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    table = quality.symbol_table(model.alphabet)
    a, b = int(table[ord("a")]), int(table[ord("b")])
    padded = [[0, 0, 0, *[a if c == "a" else b for c in t]] for t in texts]
    grams = {4: {}}
    for row in padded:
        for i in range(3, len(row)):
            key = tuple(row[i - 3 : i + 1])
            grams[4][key] = grams[4].get(key, 0) + 1
    for order in (3, 2, 1):
        grams[order] = {}
        for key in grams[order + 1]:
            grams[order][key[1:]] = grams[order].get(key[1:], 0) + 1
    def p(key):
        if not key:
            return 1 / quality.SYMBOLS
        counts = grams[len(key)]
        cut = quality._discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])
        inside = {k: v for k, v in counts.items() if k[:-1] == key[:-1]}
        if not inside:
            return p(key[1:])
        total = sum(inside.values())
        freed = sum(cut[min(v, 3) - 1] for v in inside.values()) / total
        own = counts.get(key, 0)
        return (max(own - cut[min(own, 3) - 1], 0) / total if own else 0) + freed * p(key[1:])

    log_p = model.log_table()
    for key in [(a, b, a, b), (a, b, b, a), (0, 0, 0, a), (b, b, b, b), (a, a, a, b)]:
        code = ((key[0] * 64 + key[1]) * 64 + key[2]) * 64 + key[3]
        assert math.isclose(log_p[code], math.log(p(key)), abs_tol=1e-4), key


def test_quality_keeps_clean_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels).join(labels, "doc_id").collect()
    clean = [r["kept"] for r in judged if r["quality"] == 1 and not r["toxic"]]
    junk = [r["kept"] for r in judged if r["quality"] == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.2
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality.classify(docs, labels).where("kept").count()


def test_quality_counts_every_sign_of_every_trusted_document(spark):
    """Perplexity of texts in 300 different letters, from plain counts over code points."""
    letters = [chr(0x4E00 + i) for i in range(300)]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(letters, 40)) for _ in range(30)] + ["Abab abba 12\U0001f600", "abAB"]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).where("doc_id <> 31")
    counts = {4: {}}
    for t in texts[:-1]:
        row = [None] * 3 + list(t)
        for i in range(3, len(row)):
            key = tuple(row[i - 3 : i + 1])
            counts[4][key] = counts[4].get(key, 0) + 1
    for order in (3, 2, 1):
        counts[order] = {}
        for key in counts[order + 1]:
            counts[order][key[1:]] = counts[order].get(key[1:], 0) + 1
    after = {}
    for of in counts.values():
        for key, n in of.items():
            after.setdefault((len(key), key[:-1]), []).append(n)
    cuts = {o: quality._discounts([sum(v == k for v in of.values()) for k in (1, 2, 3, 4)]) for o, of in counts.items()}

    def p(key):
        if not key:
            return 1 / 0x110000
        inside, cut = after.get((len(key), key[:-1])), cuts[len(key)]
        if not inside:
            return p(key[1:])
        own = counts[len(key)].get(key, 0)
        share = max(own - cut[min(own, 3) - 1], 0) if own else 0
        return (share + sum(cut[min(v, 3) - 1] for v in inside) * p(key[1:])) / sum(inside)

    found = {r["doc_id"]: r["perplexity"] for r in quality.classify(docs, labels).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        row = [None] * 3 + list(t)
        loss = -np.mean([math.log(p(tuple(row[j - 3 : j + 1]))) for j in range(3, len(row))])
        assert math.isclose(math.log(found[i]), loss, abs_tol=1e-4), t


def test_blocks_and_stretches_do_not_change_losses(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(60) for t in ("documents", "labels"))
    packed = ngrams.blocks(docs.coalesce(1), ["doc_id"])
    assert packed.count() == 1
    monkeypatch.setattr(ngrams, "BLOCK_BYTES", 20_000)
    small = ngrams.blocks(docs.coalesce(1), ["doc_id"])
    assert small.count() > 3 and sorted(r["doc_id"] for r in small.select(F.explode("rows.doc_id").alias("doc_id")).collect()) == sorted(
        r["doc_id"] for r in docs.collect()
    )
    all_places = F.sequence(F.lit(0), F.size("rows") - 1).alias("places")
    models = [ngrams.fit(b.select("*", all_places)) for b in (packed, small)]
    one, other = ({r["doc_id"]: r["loss"] for r in ngrams.losses(b, m, ["doc_id"]).collect()} for b, m in zip((packed, small), models))
    assert one.keys() == other.keys() and all(math.isclose(one[k], other[k], abs_tol=1e-5) for k in one)
    signs, place, _ = ngrams._signs(["".join(map(chr, range(1000, 1400))) * 3])
    whole = [ngrams._parts(code, seen) for _, code, seen in ngrams._grams(signs, place)]
    monkeypatch.setattr(ngrams, "LOCAL_SIGNS", 100)
    parts = [ngrams._parts(code, seen) for _, code, seen in ngrams._grams(signs, place)]
    assert len(whole) == 1 < len(parts)
    for k in range(2):
        assert np.array_equal(whole[0][k], np.concatenate([x[k] for x in parts]))


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (4, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(odd, labels).collect()
    assert len(found) == 8
    empty = [r for r in found if r["n_chars"] == 0]
    assert len(empty) == 2 and not any(r["kept"] or r["perplexity"] for r in empty)
    assert {r["lang"] for r in found} == {"und", "en"}
    assert quality.keep_good(odd, labels).columns == odd.columns
    unknown = quality.classify(odd, labels.limit(0)).collect()
    assert all(r["limit"] is None for r in unknown) and sum(r["kept"] for r in unknown) == 6
    assert quality.classify(odd.limit(0), labels).count() == 0


def _bag(text):
    out = {}
    for w in text.lower().split():
        out[w] = out.get(w, 0) + 1
    return out


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(80)]
    errors = []
    for _ in range(30):
        one = rng.choice(vocabulary, 60).tolist()
        other = one[:30] + rng.choice(vocabulary, 40).tolist()
        texts = [" ".join(one).encode(), " ".join(other).encode()]
        a, b = fingerprint.signatures(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]), 512)
        x, y = _bag(texts[0].decode()), _bag(texts[1].decode())
        true = sum(min(x.get(w, 0), y.get(w, 0)) for w in {*x, *y}) / sum(max(x.get(w, 0), y.get(w, 0)) for w in {*x, *y})
        errors.append(fingerprint.likeness(a, b) - true)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_collision_rate_of_long_texts():
    """Exact generalised Jaccard similarity of texts of 50,000 different words and more, also without a common one."""
    for common in (0, 20_000):
        one = [f"a{i}" for i in range(60_000)]
        other = one[:common] + [f"b{i}" for i in range(60_000 - common)] + one[: common // 2]
        texts = [" ".join(one).encode(), " ".join(other).encode()]
        offsets = np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])])
        a, b = fingerprint.signatures(np.frombuffer(b"".join(texts), np.uint8), offsets, 256)
        x, y = _bag(texts[0].decode()), _bag(texts[1].decode())
        true = sum(min(x.get(w, 0), y.get(w, 0)) for w in {*x, *y}) / sum(max(x.get(w, 0), y.get(w, 0)) for w in {*x, *y})
        assert abs(fingerprint.likeness(a, b) - true) < (0.01 if not common else 0.1)


def test_fingerprints_against_the_next_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = {r["doc_id"]: r for r in fingerprint.against_next(docs).collect()}
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert len(found) == len(texts)
    for i, (key, text) in enumerate(texts):
        after_key, after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = found[key]
        assert own["n_chars"] == len(text) and own["fingerprint"] == plain[key]
        assert own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (fingerprint.from_hex(x) for x in (plain[key], plain[after_key]))
        assert own["near_next"] == fingerprint.likeness(a, b)
        assert own["near_edited"] == fingerprint.likeness(a, fingerprint.from_hex(own["edited_fingerprint"]))


def test_fingerprints_of_odd_rows(spark, odd):
    found = fingerprint.against_next(odd).collect()
    assert len(found) == 8
    same = [r["fingerprint"] for r in found if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert {r["near_next"] for r in found if r["doc_id"] in (1, 2)} == {1.0}
    single = fingerprint.against_next(odd.where("doc_id = 4")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    assert fingerprint.against_next(odd.limit(0)).count() == 0
    assert fingerprint.fingerprints(odd.select("doc_id", F.col("text"), "id")).count() == 8
