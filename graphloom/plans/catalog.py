"""All registered queries over the reference's own operators, with their SQL for DuckDB."""

from __future__ import annotations

from graphloom.plans import file_queries, graph_queries, model_queries, text_queries, vector_queries

_MODULES = (graph_queries, text_queries, vector_queries, model_queries, file_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
