"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from placeloom.llm import budget_queries, document_queries, dup_queries, place_queries, text_queries

MODULES = (text_queries, document_queries, budget_queries, place_queries, dup_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in getattr(m, "SQL", {}).items()}
