"""All queries of the library by name, and their SQL twins."""

from __future__ import annotations

from strataloom.plans import assessments, maintenance, matches, metrics, nested, overview, repositories, scores, streams, texts

_MODULES = (texts, overview, nested, matches, metrics, scores, repositories, streams, assessments, maintenance)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
