"""All queries of the library's own operators by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.plans import flow_queries, function_queries, ledger_queries, table_queries, text_queries, tool_queries

_PARTS = (ledger_queries, table_queries, tool_queries, flow_queries, text_queries, function_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in _PARTS for name, q in part.BOOK.queries.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.BOOK.sql.items()}
