"""Prompt texts.  A template is plain text with ``[[slot]]`` marks, so braces need no escape; users
may pass their own."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

ZERO_SHOT = """Classify one row of a table.

Answer with a single JSON object and nothing around it, in the form
{"classification": <integer>, "reasoning": "<short text>"}
where classification is one of these integers: [[labels]]

Columns:
[[schema]]

[[context]]

Row to classify:
[[row]]"""

CONTEXT = "Some rows without labels, to show what the columns hold:\n"

FEW_SHOT = """Classify one row of a table.

Answer with a single JSON object and nothing around it, in the form
{"classification": <integer>, "reasoning": "<short text>"}
where classification is one of these integers: [[labels]]

Rows with known labels:
[[examples]]

Row to classify:
[[row]]"""

# The braces of the sample answer are doubled in this format.
RETRIEVAL = """These rows of a table have known labels:

[[examples]]

One more row resembles them and has none:

[[row]]

Which label fits it? Reply with a JSON object alone:
{{ "classification": <integer>, "reasoning": "<some text>" }}"""

PROPOSAL = """A classifier is wanted for the table described below. Suggest settings worth a cross-validation.

Reply with a JSON object alone, of the form
{"candidates": [{"model": "<name>", "hyperparameters": {<name>: <value>}, "why": "<a few words>"}]}
A model is one of [[models]]; its hyperparameters and their ranges are those of the catalog.
The reply is refused if it has one of the keys [[forbidden]].

Catalog: [[catalog]]

Profile of the table: [[card]]

Some of its rows, the label under "__target__": [[rows]]

Where its columns are: [[metadata]]"""

PROPOSAL_MINIMAL = """Suggest classifiers for a table you know nothing about.

Reply with a JSON object alone, of the form
{"candidates": [{"model": "<name>", "hyperparameters": {<name>: <value>}, "why": "<a few words>"}]}
A model is one of [[models]]; its hyperparameters and their ranges are those of this catalog: [[catalog]]
The reply is refused if it has one of the keys [[forbidden]]."""


def fill(template: str, **slots: Column | str) -> Column:
    """Put columns (or texts) into a template; a missing value becomes an empty text."""
    parts = []
    for i, piece in enumerate(re.split(r"\[\[(\w+)\]\]", template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
            continue
        value = slots[piece]
        parts.append(F.lit(value) if isinstance(value, str) else F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*parts)


def prompt_zero_shot(
    labels: Column, schema: Column, row: Column, context: Column | None = None, template: str = ZERO_SHOT
) -> Column:
    shown = "" if context is None else F.concat(F.lit(CONTEXT), context)
    return fill(template, labels=labels, schema=schema, context=shown, row=row)


def prompt_few_shot(labels: Column, examples: Column, row: Column, template: str = FEW_SHOT) -> Column:
    return fill(template, labels=labels, examples=examples, row=row)


def prompt_retrieval(examples: Column, row: Column, template: str = RETRIEVAL) -> Column:
    return fill(template, examples=examples, row=row)
