"""Composed jobs: derived inputs, registered queries and their oracle SQL."""

from __future__ import annotations


def all_queries() -> dict:
    from . import queries, queries_events, queries_text  # noqa: F401

    return dict(queries.QUERIES)


def all_sql() -> dict:
    from . import queries, queries_events, queries_text  # noqa: F401

    return dict(queries.SQL)
