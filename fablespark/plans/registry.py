"""All registered queries of the engine."""

from __future__ import annotations

from fablespark.plans import domain, graph_queries, ops_queries, text_queries

MODULES = (graph_queries, text_queries, ops_queries)
QUERIES, SQL = domain.QUERIES, domain.SQL
