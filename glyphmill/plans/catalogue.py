"""All queries by name, and the SQL of those that have it."""

from __future__ import annotations

from . import fixture_queries, table_queries, text_queries, verdict_queries

_ALL = (*text_queries.QUERIES, *table_queries.QUERIES, *fixture_queries.QUERIES, *verdict_queries.QUERIES)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f.sql for f in _ALL if hasattr(f, "sql")}
