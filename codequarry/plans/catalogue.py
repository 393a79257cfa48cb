"""Registered queries and the same queries for DuckDB."""

from codequarry.plans import code_queries, file_queries, review_queries, table_queries

QUERIES: dict = code_queries.QUERIES | table_queries.QUERIES | review_queries.QUERIES | file_queries.QUERIES
ORACLE_SQL: dict = code_queries.ORACLE_SQL | table_queries.ORACLE_SQL | review_queries.ORACLE_SQL | file_queries.ORACLE_SQL
