"""URL filters: longest-match rules, and block decisions carried to aliases of a page.

Aliases are pages tied by redirects and canonical links, directly or over others: the connected components
of those edges.  A page with a rule of its own takes the rule's verdict.  Without one it is blocked if a
member of its component is blocked and none is explicitly allowed; else it is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabfold.llm.components import components

#: (host, path, verdict); a rule fits its host and all subdomains, and paths that start with its path.
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_IS_CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""
_IS_REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _longest_first(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "allow"))


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does.

    Length counts host and path together; of equal rules the one that allows wins.
    """
    ordered = _longest_first(rules)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def _query(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*(\?[^#]*)", 1)


def _dotless(path: Column) -> Column:
    """A path without the steps ``.`` and ``..``; an empty one is ``/``."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    steps = F.when(last.isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)

    def step(done: Column, one: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(one == "..", up).when(one == ".", done).otherwise(F.concat(done, F.array(one)))

    walked = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    plain = ~path.contains("/.")
    return F.when(path == "", F.lit("/")).when(plain, path).otherwise(walked)


def address(url: Column) -> Column:
    """The form in which addresses are compared: scheme and host in lower case, no fragment, no dotted steps.

    Null without ``://``.
    """
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    whole = F.concat(scheme, F.lit("://"), host_of(url), _dotless(path_of(url)), _query(url))
    return F.when(url.contains("://"), whole)


def _absolute(target: Column, page: Column) -> Column:
    """What a link target on a page points to; null for other schemes than those with a host."""
    scheme = F.substring_index(page, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(page))
    folder = F.regexp_extract(path_of(page), r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(_SCHEME), F.when(target.rlike(_SCHEME + "//"), target))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("#"), page)
        .when(target.startswith("?"), F.concat(root, path_of(page), target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: addresses of a page and of each target of its canonical links and refresh redirects.

    All tags of a page count; quoted, bare and relative targets are resolved against its url.  Pages without
    url or html, or whose url has no ``://``, give no rows; neither do links of a page to itself.
    """
    rows = pages.select(F.col(url_col).cast("string").alias("page"), F.col(html_col).cast("string").alias("h"))
    rows = rows.where(F.col("page").contains("://") & F.col("h").rlike("(?i)canonical|http-equiv"))
    rows = rows.select("page", F.explode(F.regexp_extract_all("h", F.lit(_TAG), F.lit(0))).alias("tag"))
    target = F.when(F.col("tag").rlike(_IS_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(
        F.col("tag").rlike(_IS_REFRESH), F.regexp_extract("tag", _URL, 1)
    )
    rows = rows.select("page", F.regexp_replace(target, "&amp;", "&").alias("t")).where("t <> ''")
    ends = rows.select(address(F.col("page")).alias("a"), address(_absolute(F.col("t"), F.col("page"))).alias("b"))
    return ends.where("b IS NOT NULL AND a <> b")


def judge(
    pages: DataFrame,
    edges: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every page, repeated rows included.

    ``edges`` (``a, b``: in the form of ``address``) are redirects and canonical links; their ends need not be pages: a rule counts
    for them too.  A null url, or one without ``://``, has empty host and path, fits no rule and has no aliases.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    name, verdict = match(F.col("host"), F.col("path"), rules)

    def ruled(frame: DataFrame, column: str) -> DataFrame:
        there = frame.withColumns(
            {
                "host": F.coalesce(host_of(F.col(column)), F.lit("")),
                "path": F.coalesce(path_of(F.col(column)), F.lit("")),
            }
        )
        return there.withColumns({"rule": name, "said": verdict})

    found = components(edges)
    members = ruled(found, "node")
    blocked = F.max(F.coalesce(F.col("said") == "block", F.lit(False)))
    allowed = F.max(F.coalesce(F.col("said") == "allow", F.lit(False)))
    fate = members.groupBy("component").agg((blocked & ~allowed).alias("tainted"))
    aliases = found.join(fate, "component").where("tainted").select(F.col("node").alias("address"), "tainted")
    # a url may be that of many pages: the pages stay where they are when the aliases are few
    judged = ruled(rows, "url").withColumn("address", address(url)).join(aliases, "address", "left")
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("said", F.when(F.col("tainted"), F.lit("block")), F.lit(default)).alias("verdict"),
    )


def judge_sql(rules: list[Rule], default: str = "allow") -> str:
    """DuckDB: ``judge`` over table ``pages``; links are read tag by tag, components walked by recursion."""

    def parts(table: str, url: str) -> str:
        rest = f"coalesce(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END, '')"
        host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
        path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
        return f"(SELECT *, {host} AS host, {path} AS path FROM {table})"

    ordered = _longest_first(rules)
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ordered]
    name = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered)) + " END"
    said = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered)) + " END"
    def after(url: str) -> str:
        return f"substr({url}, strpos({url}, '://') + 3)"

    def host(url: str) -> str:
        return f"translate(regexp_extract({after(url)}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"

    def path(url: str) -> str:
        return f"regexp_extract({after(url)}, '^[^/?#]*([^?#]*)', 1)"

    def scheme(url: str) -> str:
        return f"substr({url}, 1, strpos({url}, '://') - 1)"

    def addressed(url: str) -> str:
        steps = f"string_split({path(url)}, '/')"
        steps = f"(CASE WHEN {steps}[-1] IN ('.', '..') THEN list_append({steps}, '') ELSE {steps} END)"
        walked = f"""array_to_string(list_reduce(list_transform({steps}, lambda s: [s]), lambda done, one: CASE
          WHEN one = ['..'] THEN CASE WHEN len(done) > 1 THEN done[1:len(done) - 1] ELSE done END
          WHEN one = ['.'] THEN done ELSE list_concat(done, one) END), '/')"""
        query = f"regexp_extract({after(url)}, '^[^?#]*(\\?[^#]*)', 1)"
        tidy = f"CASE WHEN {path(url)} = '' THEN '/' ELSE {walked} END"
        return f"CASE WHEN contains({url}, '://') THEN translate({scheme(url)}, '{_UPPER}', '{_LOWER}') || '://' || {host(url)} || {tidy} || {query} END"

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    root = f"{scheme('page')} || '://' || {host('page')}"
    folder = f"regexp_extract({path('page')}, '^(.*/)', 1)"
    return rf"""WITH RECURSIVE tags AS (
  SELECT url AS page, unnest(regexp_extract_all(html, {quoted(_TAG)})) AS tag FROM pages WHERE contains(url, '://')),
targets AS (
  SELECT page, regexp_extract(tag, {quoted(_HREF)}, 1) AS t FROM tags WHERE regexp_matches(tag, {quoted(_IS_CANONICAL)})
  UNION ALL
  SELECT page, regexp_extract(tag, {quoted(_URL)}, 1) FROM tags WHERE regexp_matches(tag, {quoted(_IS_REFRESH)})),
resolved AS (
  SELECT page, CASE WHEN regexp_matches(t, '{_SCHEME}') THEN CASE WHEN regexp_matches(t, '{_SCHEME}//') THEN t END
                    WHEN starts_with(t, '//') THEN {scheme('page')} || ':' || t WHEN starts_with(t, '/') THEN {root} || t
                    WHEN starts_with(t, '#') THEN page WHEN starts_with(t, '?') THEN {root} || {path('page')} || t
                    ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || t END AS target
  FROM (SELECT page, replace(t, '&amp;', '&') AS t FROM targets WHERE t <> '')),
edges AS (SELECT {addressed('page')} AS a, {addressed('target')} AS b FROM resolved WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT a, b FROM both_ways UNION SELECT w.a, e.b FROM walk w JOIN both_ways e ON w.b = e.a),
reached AS (SELECT a, {said} AS said FROM {parts("(SELECT a, b AS url FROM walk UNION SELECT a, a FROM walk)", "url")}),
tainted AS (SELECT a FROM reached GROUP BY a HAVING bool_or(coalesce(said = 'block', false)) AND NOT bool_or(coalesce(said = 'allow', false)))
SELECT page_id, host, path, {name} AS rule,
  coalesce({said}, CASE WHEN {addressed('url')} IN (SELECT a FROM tainted) THEN 'block' END, '{default}') AS verdict
FROM {parts("pages", "url")}"""
