"""The queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from vellumlake.plans import audit_queries, formula_queries, function_queries, layout_queries, structure_queries, text_queries

_FAMILIES = (text_queries, structure_queries, audit_queries, formula_queries, layout_queries, function_queries)
QUERIES: dict = {k: v for f in _FAMILIES for k, v in f.QUERIES.items()}
ORACLE_SQL: dict = {k: v for f in _FAMILIES for k, v in f.ORACLE_SQL.items()}
