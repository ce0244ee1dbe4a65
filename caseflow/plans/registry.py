"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from caseflow.plans import extract_queries, graph_queries, ledger_queries, retrieval_queries

MODULES = (graph_queries, extract_queries, retrieval_queries, ledger_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
