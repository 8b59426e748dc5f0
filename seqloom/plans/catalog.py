"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from seqloom.plans import file_queries, index_queries, profile_queries, search_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (search_queries, index_queries, profile_queries, file_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
