"""All core queries and their SQL, by name."""

from __future__ import annotations

from kinfold.plans import command_queries, core_problems, feature_queries, file_queries, source_queries, stream_queries, text_queries

_MODULES = [core_problems, file_queries, text_queries, stream_queries, command_queries, feature_queries, source_queries]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
