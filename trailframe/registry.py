"""Registered queries: one name, one function (spark, sf_dir) -> DataFrame, and the same in SQL."""

from __future__ import annotations

from trailframe.plans import chain_queries, edit_queries, extract_queries, graph_queries, line_queries, live_queries, queries, report_queries, rule_text_queries, rules_queries, source_queries, trip_queries

_MODULES = (queries, rules_queries, source_queries, extract_queries, rule_text_queries, trip_queries, graph_queries, live_queries, report_queries, line_queries, chain_queries, edit_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}

FLAGSHIP = "RSP1_shortest_paths"
