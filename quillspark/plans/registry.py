"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import model_queries, relational_queries, signal_queries, source_queries, text_queries

_PARTS = (model_queries, signal_queries, text_queries, relational_queries, source_queries)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
