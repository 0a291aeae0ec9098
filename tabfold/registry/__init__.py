"""Every operator as a query over the test tables, with an equal SQL text where SQL can say it."""

from __future__ import annotations

from tabfold.registry import (
    candidates,
    cleaning,
    measures,
    models,
    prompted,
    sampling,
    search,
    tables,
    texts,
)

_PARTS = [tables, cleaning, sampling, search, measures, texts, candidates, models, prompted]


def all_queries() -> dict:
    return {name: run for part in _PARTS for name, run in part.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
