"""All queries of the library by name, and their SQL."""

from . import check_queries, code_queries, memory_queries, search_queries

_PARTS = (search_queries, memory_queries, code_queries, check_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
