"""Queries over the test tables and their SQL equivalents."""

from tallyhound.plans import bundle_queries, case_queries, evidence_queries, graph_queries, projection_queries, read_queries, rule_queries, run_queries, store_queries, stream_queries, table_queries

MODULES = (rule_queries, graph_queries, projection_queries, case_queries, table_queries, read_queries, run_queries, store_queries, evidence_queries, stream_queries, bundle_queries)
ALL_QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ALL_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
