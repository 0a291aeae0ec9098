"""Benchmark decontamination by template windows, with DataFrame functions only.

Only documents that can leak are looked at closely: a window that counts has literal words in a row that document and
item share, so runs of tokens, cut from whole texts by one regular expression, tell the others apart.  Words become templates: numbers, units after numbers, and names (capitals inside a sentence) turn into typed
placeholders, all else into lower case without closing punctuation.  Hashes of every window of ``WINDOW``
template words of the documents are joined with those of the benchmark items, and equal windows are
compared word by word.  Windows with too many placeholders, and short items, are looked for word for word.
Matches of a document and an item at one offset form an alignment; it counts if its slots are consistent: one
value of the item always stands for the same value of the document, be it the item's own or another, and at most
``SHARED`` values of the item meet in one of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabfold.workspace import stage

WINDOW = 8
#: Words of a window that must not be placeholders; with fewer it is looked for word for word.
LITERALS = 4
#: Words of the shortest item that is looked for inside longer documents.
SHORTEST = 4
#: Values of an item that one value of a document may stand for.
SHARED = 2
#: A document leaks an item if aligned windows cover this share of it, or one alignment so many words.
COVERAGE = 0.5
RUN = 13
#: Tokens of a run by which documents are chosen; windows with fewer literals in a row have shorter runs.
GRAM = 4
#: Windows of benchmark items up to which they are broadcast; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 2_000_000

NUMBER, UNIT, NAME = "<n>", "<u>", "<p>"
#: Units. Fixed values.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometers kilometres"
    " mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres"
    " gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year"
    " years percent % dollar dollars usd euro euros eur cent cents degrees celsius fahrenheit mph kmh"
).split()
_CLOSING = ".,;:!?\"')]}"


def _bare(word: Column) -> Column:
    """In lower case without closing punctuation; most words have none, and trimming is dear."""
    low = F.lower(word)
    return F.when(F.substring(word, -1, 1).isin(*_CLOSING), F.rtrim(low, F.lit(_CLOSING))).otherwise(low)


def _raw(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _is_number(word: Column) -> Column:
    first = F.ascii(word)
    return first.between(48, 57) | ((first == 36) & F.ascii(F.substring(word, 2, 1)).between(48, 57))


def template(raw: Column) -> Column:
    """Template words of an array of words, one for one."""

    def word(t: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(raw, i - 1)).otherwise(F.lit("."))
        bare = _bare(t)
        inside = ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
        capital = F.substring(t, 1, 1) != F.lower(F.substring(t, 1, 1))
        return (
            F.when(_is_number(t), F.lit(NUMBER))
            .when(capital & inside, F.lit(NAME))
            .when(_is_number(before) & bare.isin(UNITS), F.lit(UNIT))
            .otherwise(bare)
        )

    return F.transform(raw, word)


def _templated(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = frame.select(F.col(id_col).alias("id"), _raw(F.col(text_col).cast("string")).alias("raw"))
    return text.select("id", "raw", template(F.col("raw")).alias("words"))


def _starts(size: int) -> Column:
    """First positions, from 1, of the windows of ``words``; fewer words are one window."""
    return F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))


def _hash(at: Column, size: int) -> Column:
    """Hash of a window of ``hashes``, which holds that of each template word."""
    return F.xxhash64(F.slice("hashes", at, size))


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def _exact(words: Column, raw: Column) -> Column:
    """Template words with the document's own in the place of placeholders."""
    return F.transform(words, lambda w, i: F.when(_is_slot(w), _bare(F.get(raw, i))).otherwise(w))


def _hashed(templated: DataFrame) -> DataFrame:
    """With ``hashes`` of template words and ``exacts`` of the words themselves, which differ in slots only."""
    hashed = templated.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    own = lambda h, i: F.when(_is_slot(F.get("words", i)), F.xxhash64(_bare(F.get("raw", i)))).otherwise(h)
    return hashed.withColumn("exacts", F.transform("hashes", own))


def _poor_starts(size: int) -> Column:
    """First positions, from 1, of the windows with fewer than ``LITERALS`` literals, found from slot to slot."""
    slots = F.array_compact(F.transform("words", lambda w, i: F.when(_is_slot(w), i + 1)))
    many = size - LITERALS + 1  # slots that make a window poor

    def around(one: Column, j: Column) -> Column:
        reach = F.get(slots, j + many - 1)  # null behind the last slots
        first = F.greatest(reach - size + 1, F.lit(1))
        last = F.least(one, F.size("words") - size + 1)
        return F.when(reach.isNotNull() & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(slots) >= many, F.array_distinct(F.flatten(F.transform(slots, around)))).otherwise(F.array().cast("array<int>"))


def _windows(size: int, lengths: list[int]) -> Column:
    """``at, hash`` of all windows that are looked up: by template, poor ones and short lengths word for word."""
    exact = lambda width: lambda at: F.struct((at - 1).alias("at"), F.xxhash64(F.slice("exacts", at, width)).alias("hash"))
    rich = F.transform(_starts(size), lambda at: F.struct((at - 1).alias("at"), _hash(at, size).alias("hash")))
    out = [rich, F.transform(_poor_starts(size), exact(size))]
    for width in lengths:
        fits = F.size("words") >= width
        starts = F.when(fits, F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))))
        out.append(F.transform(F.coalesce(starts, F.array().cast("array<int>")), exact(width)))
    return F.concat(*out)


def _tokens(text: Column) -> Column:
    """Parts of words between closing signs, without regard to case; empty ones may stand at both ends.

    Words that ``_bare`` makes equal have equal tokens.  A capital sigma is lowered by what stands behind it, so both forms are one.
    """
    signs = "".join("\\" + c for c in _CLOSING)
    return F.split(F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3")), rf"[\s{signs}]+")


def _telling(items: DataFrame, size: int) -> DataFrame:
    """``width, gram``: a document of ``size`` words or more that leaks an item has one of these runs of tokens.

    Of each window one run is taken from its longest literals, where it is looked for word for word from all words.  A
    leak hits several windows of its item, so as many but one, those with the shortest runs, are left out.  A run of
    width 0 is in every document.
    """
    words = _exact(F.col("item_window"), F.col("item_raw"))
    literal = F.transform("item_window", lambda w: F.col("exact") | ~_is_slot(w))
    # a blank between words, a break for each that may differ
    told = F.array_join(F.transform(words, lambda w, i: F.when(F.get(literal, i), w).otherwise("\n")), " ")
    stretches = F.transform(F.split(told, "\n"), lambda t: F.filter(_tokens(t), lambda w: w != ""))
    longest = F.array_max(F.transform(stretches, lambda t: F.struct(F.size(t).alias("n"), t.alias("tokens"))))["tokens"]
    spots = items.where(F.col("exact") | (F.size("item_window") == size)).select("item", "item_windows", "item_at", longest.alias("tokens"))
    width = F.least(F.size("tokens"), F.lit(GRAM))
    gram = F.array_min(F.filter(_grams(_hashes("tokens"), width), lambda h: h.isNotNull()))
    spots = spots.select("item", "item_windows", "item_at", F.struct(width.alias("width"), F.coalesce(gram, F.lit(0)).alias("gram")).alias("run"))
    spots = spots.groupBy("item", "item_windows", "item_at").agg(F.min("run.width").alias("least"), F.collect_set("run").alias("runs"))
    needed = F.least(F.ceil(F.col("item_windows") * COVERAGE), F.lit(max(RUN - size + 1, 1)))
    weakest = Window.partitionBy("item", "item_windows").orderBy("least", "item_at")
    kept = spots.withColumn("at", F.row_number().over(weakest)).where(F.col("at") >= needed)
    return kept.select(F.explode("runs").alias("run")).select("run.*").distinct()


def _hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _grams(hashes: Column, width: Column | int) -> Column:
    """Hash of each run of ``width`` hashes, null for runs that would go beyond the last."""
    ways = range(1, GRAM + 1) if isinstance(width, Column) else [width]

    def gram(h: Column, i: Column) -> Column:
        out = None
        for n in ways:
            run = F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, n)])
            fits = (i + n <= F.size(hashes)) & (F.lit(n) == width)
            out = F.when(fits, run) if out is None else out.when(fits, run)
        return out

    return F.transform(hashes, gram)


def _suspects(docs: DataFrame, telling: DataFrame, id_col: str, text_col: str, size: int, small: bool) -> DataFrame:
    """All rows of the ids one of whose documents may leak: a short one, or one with a telling run."""
    telling = stage(telling, "telling")
    widths = sorted(r[0] for r in telling.select("width").distinct().collect())  # at most GRAM + 1
    if 0 in widths:
        return docs
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # one more for an empty word at each end
    ids = docs.where(F.size(F.split(text, r"\s+", size + 2)) < size + 2).select(F.col(id_col).alias("suspect"))
    hashed = docs.select(F.col(id_col).alias("suspect"), _tokens(text).alias("tokens")).select("suspect", _hashes("tokens").alias("hashes"))
    for width in widths:
        known = telling.where(F.col("width") == width).select("gram")
        held = hashed.select("suspect", F.explode(_grams(F.col("hashes"), width)).alias("gram"))
        ids = ids.union(held.join(F.broadcast(known) if small else known, "gram").select("suspect"))
    ids = stage(ids.distinct(), "suspects").hint("merge")  # they grow with the corpus
    return docs.join(ids, docs[id_col].eqNullSafe(ids["suspect"]), "left_semi")


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """``id, item, n_windows, coverage, n_slots, verbatim``: one row for each leaked item of a document.

    ``n_windows`` counts the item's windows in consistent alignments, ``coverage`` is their share, ``n_slots``
    counts different slot values, ``verbatim`` tells that all are the item's own.  Null and blank texts
    match nothing.  Windows with fewer than ``LITERALS`` words besides placeholders must be equal word for word.
    An item, or a document, of fewer than ``size`` words is one window; an item of ``SHORTEST`` to ``size``
    words is also found word for word inside longer documents, a shorter one only in a document that holds
    nothing else.  Repeated items are items of their own, documents that repeat an id are judged together.
    """
    items = _hashed(_templated(benchmark, item_col, item_text_col).where(F.size("words") > 0))
    cut = F.transform(
        _starts(size),
        lambda at: F.struct(
            (at - 1).alias("item_at"),
            _hash(at, size).alias("alike"),
            F.xxhash64(F.slice("exacts", at, size)).alias("same"),
            F.slice("words", at, size).alias("item_window"),
            F.slice("raw", at, size).alias("item_raw"),
            F.greatest(F.size("words") - size + 1, F.lit(1)).alias("item_windows"),
            (F.size("words") <= size).alias("single"),
        ),
    )
    items = items.select(F.col("id").alias("item"), F.explode(cut).alias("cut")).select("item", "cut.*")
    width = F.size("item_window")
    literal = F.size(F.filter("item_window", lambda w: ~_is_slot(w)))
    rich = literal >= F.least(F.lit(LITERALS), width)
    short = F.col("single") & (width >= SHORTEST)
    ways = F.array(
        F.when(rich, F.struct(F.col("alike").alias("hash"), F.lit(False).alias("exact"))),
        F.when(short | (~rich & (width == size)), F.struct(F.col("same").alias("hash"), F.lit(True).alias("exact"))),
    )
    items = items.select("*", F.explode(F.array_compact(ways)).alias("way")).select("*", "way.*").drop("way", "alike", "same")
    items = stage(items, "items")
    lengths = sorted(r[0] for r in items.where("single AND exact").select(width).distinct().collect())  # at most size
    hashes = items.select("hash").distinct()
    small = items.count() <= BROADCAST_WINDOWS
    looked_for = F.broadcast(hashes) if small else hashes
    docs = stage(_suspects(docs.select(id_col, text_col), _telling(items, size), id_col, text_col, size, small), "suspect-texts")

    # first only hashes travel; the words of a document come in where it has a hit
    templated = _hashed(_templated(docs, id_col, text_col))
    windows = templated.select("id", F.explode(_windows(size, lengths)).alias("w")).select("id", "w.*")
    hits = windows.join(looked_for, "hash").groupBy("id").agg(F.collect_set(F.struct("at", "hash")).alias("hits"))
    hits = stage(hits.withColumnRenamed("id", "hit"), "hits")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("hit")))  # hits grow with the corpus
    texts = texts.select("id", "hits", _raw(F.col("text").cast("string")).alias("raw"))
    texts = texts.select("id", "hits", "raw", template(F.col("raw")).alias("words"))
    lifted = F.transform(
        "hits",
        lambda h: F.struct(
            h["at"].alias("at"),
            h["hash"].alias("hash"),
            F.slice("words", h["at"] + 1, size).alias("window"),
            F.slice("raw", h["at"] + 1, size).alias("doc_raw"),
        ),
    )
    found = texts.select("id", F.explode(lifted).alias("hit")).select("id", "hit.*").join(items, "hash")
    found = found.where(
        F.when(~F.col("exact"), F.col("window") == F.col("item_window")).otherwise(
            F.slice(_exact(F.col("window"), F.col("doc_raw")), 1, F.size("item_window")) == _exact(F.col("item_window"), F.col("item_raw"))
        )
    )
    found = found.withColumn("doc_raw", F.slice("doc_raw", 1, F.size("item_window")))
    pairs = F.arrays_zip(F.col("item_window").alias("kind"), F.col("item_raw").alias("item"), F.col("doc_raw").alias("doc"))
    bare = lambda c: F.rtrim(F.lower(c), F.lit(_CLOSING))
    slots = F.transform(
        F.filter(pairs, lambda p: p["kind"].isin(NUMBER, UNIT, NAME)),
        lambda p: F.struct(p["kind"].alias("kind"), bare(p["item"]).alias("item"), bare(p["doc"]).alias("doc")),
    )
    offset = (F.col("at") - F.col("item_at")).alias("offset")
    found = found.select("id", "item", "item_at", offset, "item_windows", slots.alias("slots"))
    aligned = found.groupBy("id", "item", "offset", "item_windows").agg(
        F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    theirs = F.transform("slots", lambda s: F.struct(s["kind"], s["item"]))
    alike = lambda s: lambda t: (t["kind"] == s["kind"]) & (t["doc"] == s["doc"])
    few = F.forall("slots", lambda s: F.size(F.filter("slots", alike(s))) <= SHARED)
    aligned = aligned.where((F.size(F.array_distinct(theirs)) == F.size("slots")) & few)
    judged = aligned.groupBy("id", "item", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("n"),
        F.max(F.size("places")).alias("longest"),
        F.max(F.size("slots")).alias("n_slots"),
        F.max(F.forall("slots", lambda s: s["item"] == s["doc"])).alias("verbatim"),
    )
    leaked = (F.col("n") >= F.col("item_windows") * COVERAGE) | (F.col("longest") + size - 1 >= RUN)
    return judged.where(leaked).select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        F.col("n").cast("long").alias("n_windows"),
        (F.col("n") / F.col("item_windows")).alias("coverage"),
        F.col("n_slots").cast("long").alias("n_slots"),
        "verbatim",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that leak no item, with all their columns."""
    leaked = leaks(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("leaked_id")).distinct()
    leaked = stage(leaked, "leaked").hint("merge")
    return docs.join(leaked, docs[id_col].eqNullSafe(leaked["leaked_id"]), "left_anti")


def leaks_sql(size: int = WINDOW) -> str:
    """DuckDB: ``leaks`` of table ``documents`` against table ``benchmark``."""
    closing = "'" + _CLOSING.replace("'", "''") + "'"
    marks = ", ".join(f"'{m}'" for m in (NUMBER, UNIT, NAME))
    units = ", ".join(f"'{u}'" for u in UNITS)

    def number(word: str) -> str:
        return f"(ascii({word}) BETWEEN 48 AND 57 OR (ascii({word}) = 36 AND ascii(substr({word}, 2, 1)) BETWEEN 48 AND 57))"

    def templated(table: str, key: str) -> str:
        before = "(CASE WHEN i > 1 THEN raw[i - 1] ELSE '.' END)"
        word = f"""CASE WHEN {number("t")} THEN '{NUMBER}'
      WHEN left(t, 1) <> lower(left(t, 1)) AND right({before}, 1) NOT IN ('.', '!', '?', ':') THEN '{NAME}'
      WHEN {number(before)} AND rtrim(lower(t), {closing}) IN ({units}) THEN '{UNIT}'
      ELSE rtrim(lower(t), {closing}) END"""
        raw = r"list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')"
        return f"""(SELECT id, raw, list_transform(raw, lambda t, i: {word}) AS words FROM (SELECT {key} AS id, {raw} AS raw FROM {table}))"""

    def exact(win: str, raw: str) -> str:
        return f"list_transform({win}, lambda w, i: CASE WHEN w IN ({marks}) THEN rtrim(lower({raw}[i]), {closing}) ELSE w END)"

    def windows(source: str) -> str:
        return f"""(SELECT id, len(words) AS n, words[s:s + {size - 1}] AS win, raw[s:s + {size - 1}] AS raw, s - 1 AS at, greatest(len(words) - {size - 1}, 1) AS total
    FROM (SELECT *, unnest(generate_series(1, greatest(len(words) - {size - 1}, 1))) AS s FROM {source} WHERE len(words) > 0))"""

    return f"""WITH doc AS (SELECT * FROM {templated("documents", "doc_id")}),
items AS (SELECT *, len(list_filter(win, lambda w: w NOT IN ({marks}))) >= least({LITERALS}, len(win)) AS rich, {exact("win", "raw")} AS same
  FROM {windows(templated("benchmark", "item_id"))}),
cut AS (SELECT id, win, raw, "at" FROM {windows("doc")}),
poor AS (SELECT *, {exact("win", "raw")} AS same FROM cut
  WHERE len(win) = {size} AND len(list_filter(win, lambda w: w NOT IN ({marks}))) < {LITERALS}),
widths AS (SELECT DISTINCT n AS width FROM items WHERE n BETWEEN {SHORTEST} AND {size}),
short AS (SELECT *, {exact("win", "raw")} AS same FROM (SELECT id, s - 1 AS at, words[s:s + width - 1] AS win, raw[s:s + width - 1] AS raw
  FROM (SELECT *, unnest(generate_series(1, len(words) - width + 1)) AS s FROM doc JOIN widths ON len(words) >= width))),
met AS (
  SELECT d.id, d.at AS pos, d.raw AS doc_raw, i.id AS item, i.at AS item_at, i.total, i.win, i.raw AS item_raw FROM cut d JOIN items i ON d.win = i.win WHERE rich
  UNION ALL
  SELECT d.id, d.at AS pos, d.raw AS doc_raw, i.id AS item, i.at AS item_at, i.total, i.win, i.raw AS item_raw FROM poor d JOIN items i ON d.same = i.same WHERE NOT rich AND i.n >= {size}
  UNION ALL
  SELECT d.id, d.at AS pos, d.raw AS doc_raw, i.id AS item, i.at AS item_at, i.total, i.win, i.raw AS item_raw FROM short d JOIN items i ON d.same = i.same WHERE i.n BETWEEN {SHORTEST} AND {size}),
found AS (SELECT id, item, item_at, pos - item_at AS shift, total, win, item_raw, doc_raw FROM met),
places AS (SELECT DISTINCT id, item, shift, total, item_at FROM found),
slots AS (SELECT DISTINCT id, item, shift, win[j] AS kind, rtrim(lower(item_raw[j]), {closing}) AS theirs, rtrim(lower(doc_raw[j]), {closing}) AS ours
  FROM (SELECT *, unnest(generate_series(1, len(win))) AS j FROM found) WHERE win[j] IN ({marks})),
values_of AS (SELECT id, item, shift, count(*) AS n_slots, bool_and(theirs = ours) AS verbatim,
    count(*) = count(DISTINCT (kind, theirs)) AND max(shared) <= {SHARED} AS consistent
  FROM (SELECT *, count(*) OVER (PARTITION BY id, item, shift, kind, ours) AS shared FROM slots) GROUP BY id, item, shift),
sized AS (SELECT *, count(*) OVER (PARTITION BY id, item, shift) AS run FROM places),
judged AS (SELECT p.id, p.item, p.total, count(DISTINCT item_at) AS n, max(run) AS longest,
    max(coalesce(n_slots, 0)) AS n_slots, bool_or(coalesce(verbatim, true)) AS verbatim
  FROM sized p LEFT JOIN values_of v ON p.id IS NOT DISTINCT FROM v.id AND p.item = v.item AND p.shift = v.shift
  WHERE coalesce(consistent, true) GROUP BY p.id, p.item, p.total)
SELECT id AS doc_id, item AS item_id, n AS n_windows, n / total AS coverage, n_slots, verbatim
FROM judged WHERE n >= total * {COVERAGE} OR longest + {size - 1} >= {RUN}"""
