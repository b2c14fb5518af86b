"""All registered queries and their SQL, by name."""

from __future__ import annotations

from . import catalog_queries, evaluation_queries, policy_queries, profile_queries, search_queries, sql_queries, table_queries

_PARTS = (profile_queries, catalog_queries, search_queries, policy_queries, sql_queries, evaluation_queries, table_queries)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
