"""Every query of the engine's own operators, and the SQL it is held against."""

from __future__ import annotations

from tessera.plans import audit_queries, change_queries, check_queries, code_queries, corpus_queries, findings_queries, graph_queries, line_queries, memory_queries, posture_queries, search_queries, source_queries, table_queries

_MODULES = (search_queries, line_queries, findings_queries, memory_queries, graph_queries, change_queries, table_queries, code_queries, audit_queries, source_queries, corpus_queries, check_queries, posture_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
