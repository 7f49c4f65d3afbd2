"""Queries by name, each with its SQL oracle where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; views are common tables that its SQL starts with."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            recursive = "recursive " if "/*recursive*/" in sql else ""
            ORACLE_SQL[name] = f"with {recursive}" + ",\n".join(views) + (",\n" if sql.lstrip().startswith(("/*and*/", "/*recursive*/")) else "\n") + sql if views else sql
        return f

    return add
