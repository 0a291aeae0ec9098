"""ARFF files: attribute header on the driver, body parsed by Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabfold.sources.delimited import sink_csv_header
from tabfold.sources.lines import number_rows, with_locator

MAX_HEADER_LINES = 1 << 20


@dataclass
class Attribute:
    name: str
    kind: str  # number, nominal or date
    values: tuple[str, ...] = ()
    pattern: str = ""


_NAME = re.compile(r"""@attribute\s+("(?:[^"]*)"|'(?:[^']*)'|\S+)\s+(.*)$""", re.IGNORECASE)
_VALUE = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^,]*?)\s*(?:,|$)""")


def _bare(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def _quoted(value: str) -> str:
    return "'" + re.sub(r"([\\'])", r"\\\1", value) + "'"


def _attribute(line: str) -> Attribute:
    match = _NAME.match(line.strip())
    if not match:
        raise ValueError(f"not an attribute: {line!r}")
    name, kind = _bare(match.group(1)), match.group(2).strip()
    if kind.startswith("{"):
        inner = kind[1 : kind.rindex("}")]
        return Attribute(name, "nominal", tuple(_bare(v) for v in _VALUE.findall(inner) if v.strip()))
    word = kind.split()[0].lower()
    if word in ("numeric", "real", "integer"):
        return Attribute(name, "number")
    if word == "date":
        return Attribute(name, "date", pattern=_bare(kind[4:].strip() or "yyyy-MM-dd'T'HH:mm:ss"))
    raise NotImplementedError(f"attribute type {word!r} of {name!r}")


def read_header(spark: SparkSession, path: str) -> list[Attribute]:
    """Attributes in order.  The header stands at the top of the first file."""
    first = sorted(spark.read.text(path).inputFiles())[0]
    lines, asked = [], 256
    while asked <= MAX_HEADER_LINES:
        lines = [r["value"] for r in spark.read.text(first).head(asked)]
        if any(x.strip().lower().startswith("@data") for x in lines) or len(lines) < asked:
            break
        asked *= 4
    attributes, complete = [], False
    for line in lines:
        word = line.strip().lower()
        if word.startswith("@attribute"):
            attributes.append(_attribute(line))
        elif word.startswith("@data"):
            complete = True
            break
    if not complete:
        raise ValueError(f"no @data line among the first {len(lines)} lines of {first}")
    if not attributes:
        raise ValueError(f"no attributes in {first}")
    return attributes


def scan_arff(
    spark: SparkSession, path: str, *, row_id: str | None = None, keep_question_mark: bool = False
) -> DataFrame:
    """Typed table of an ARFF file or folder; ``?`` is a missing value.

    Values outside a nominal attribute's list fail the job.  With ``keep_question_mark`` a missing
    nominal value stays the text ``?``.
    """
    attributes = read_header(spark, path)
    lines = spark.read.text(path)
    text = F.trim("value")
    body = ~(text.startswith("%") | (text == "") | F.lower(text).rlike("^@(relation|attribute|data)"))
    if row_id:
        lines = number_rows(with_locator(lines.filter(body), ["value"]), row_id)
    else:
        lines = lines.filter(body)
    schema = T.StructType([T.StructField(str(i), T.StringType()) for i in range(len(attributes))])
    # both quote characters are allowed; from_csv knows one, so the first of a line decides
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "mode": "FAILFAST"}
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    fields = F.when(
        F.regexp_extract(text, "['\"]", 0) == "'", F.from_csv(text, ddl, {**options, "quote": "'"})
    ).otherwise(F.from_csv(text, ddl, {**options, "quote": '"'}))
    parsed = lines.select(*([row_id] if row_id else []), fields.alias("f"))

    def column(i: int, a: Attribute):
        value = F.col(f"f.`{i}`")
        known = F.when(value != "?", value)
        if a.kind == "number":
            number = known.try_cast("double")
            bad = known.isNotNull() & number.isNull()
            return F.when(bad, F.raise_error(F.concat(F.lit(f"{a.name}: not a number: "), value))).otherwise(number)
        if a.kind == "date":
            return F.to_timestamp(known, a.pattern)
        bad = known.isNotNull() & ~known.isin(list(a.values))
        checked = F.when(
            bad, F.raise_error(F.concat(F.lit(f"{a.name}: not in the list: "), value))
        ).otherwise(value if keep_question_mark else known)
        return checked.cast("string")

    return parsed.select(
        *([row_id] if row_id else []), *[column(i, a).alias(a.name) for i, a in enumerate(attributes)]
    )


def sink_arff(df: DataFrame, path: str, relation: str, nominal: dict[str, list[str]]) -> None:
    """Write a folder whose first file is the header; string columns need their value lists."""

    def kind(f: T.StructField) -> str:
        if f.name in nominal:
            return "{" + ",".join(_quoted(v) for v in nominal[f.name]) + "}"
        return "numeric"

    header = [f"@relation {relation}"]
    header += [f"@attribute '{f.name}' {kind(f)}" for f in df.schema.fields]
    header += ["@data"]
    cells = [
        F.coalesce(
            F.concat(F.lit("'"), F.regexp_replace(f"`{f.name}`", r"([\\'])", r"\\$1"), F.lit("'"))
            if f.name in nominal
            else F.col(f"`{f.name}`").cast("string"),
            F.lit("?"),
        )
        for f in df.schema.fields
    ]
    top = df.sparkSession.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
    top.union(df.select(F.concat_ws(",", *cells).alias("value"))).write.text(path)


def convert_arff_csv(spark: SparkSession, source: str, target: str | None = None) -> str:
    """ARFF to CSV with a header line; the name defaults to the source's with ``.csv``."""
    target = target or re.sub(r"(\.arff)?/?$", ".csv", source, count=1, flags=re.IGNORECASE)
    sink_csv_header(scan_arff(spark, source), target)
    return target
