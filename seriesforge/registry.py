"""Queries of the library, and their SQL for DuckDB."""

from __future__ import annotations

from seriesforge.plans import axis_queries, extract, page_queries, record_queries, report_queries, series_queries

_MODULES = (series_queries, page_queries, record_queries, axis_queries, extract, report_queries)

QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
