"""All core queries and their SQL."""

from __future__ import annotations

from placeloom.plans import engine_queries, geo_queries

MODULES = (geo_queries, engine_queries)
FLAGSHIP = "resolve_as_written"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
