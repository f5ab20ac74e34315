"""All queries over the corpus operators, with their SQL."""

from __future__ import annotations

from corpusloom.plans import corpus_queries, result_queries, search_queries  # noqa: F401  they register
from corpusloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
