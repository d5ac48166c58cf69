"""Registry that pairs a Spark query over the test tables with an equal DuckDB query."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.tables_sql import TABLES
from pulsepress.sources.fixtures import Fixtures

AS_OF = "2024-02-01"
WINDOW = "15 days"
EPS = 1.15
FAR = 0.9

_queries: dict[str, Callable[[Fixtures], DataFrame]] = {}
_sql: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the tables of ``checks.tables_sql`` and start with WITH."""

    def add(build: Callable[[Fixtures], DataFrame]):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = build
        if sql:
            _sql[name] = _with_tables(sql.strip())
        return build

    return add


def _with_tables(sql: str) -> str:
    wanted: list[str] = []

    def need(text: str) -> None:
        for table in TABLES:
            if table not in wanted and re.search(rf"\b{table}\b", text):
                need(TABLES[table])
                if table not in wanted:
                    wanted.append(table)

    need(sql)
    tables = [f"{name} AS ({TABLES[name].strip()})" for name in TABLES if name in wanted]
    if sql.upper().startswith("WITH "):
        tables.append(sql[5:])
        return "WITH " + ",\n".join(tables)
    return ("WITH " + ",\n".join(tables) + "\n" if tables else "") + sql


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, folder: build(Fixtures(spark, folder))

    return {name: bind(build) for name, build in _queries.items()}


def duckdb_queries() -> dict[str, str]:
    return dict(_sql)


def moment(column, name: str | None = None):
    """Timestamp as text with microseconds, the same in both engines."""
    text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return text.alias(name or column)


def day(column, name: str | None = None):
    return F.date_format(column, "yyyy-MM-dd").alias(name or column)


def joined(column, name: str | None = None):
    return F.array_join(F.col(column) if isinstance(column, str) else column, "|").alias(name or column)


def rounded(column, name: str | None = None):
    return F.round(column, 6).alias(name or column)
