"""Where queries and their SQL equivalents are kept."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model_sql import TABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """sql behind the definitions of the model tables (m_...) that it uses."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bm_\w+", text):
            if name in TABLES and name not in used:
                used.append(name)
                need(TABLES[name])

    need(sql)
    ordered = [n for n in TABLES if n in used]
    tables = ", ".join(f"{n} AS ({TABLES[n]})" for n in ordered)
    if sql.startswith("WITH "):  # its own definitions come after the tables
        return f"WITH RECURSIVE {tables}, {sql[5:]}" if ordered else sql
    return f"WITH RECURSIVE {tables} {sql}" if ordered else sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql: what it computes, for DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        f.sql = sql
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql.strip())
        return f

    return add
