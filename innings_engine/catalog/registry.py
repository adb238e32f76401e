"""Registration of queries and assembly of their SQL texts."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    """Define a named subquery that SQL texts may use; order of definition matters."""
    CTES[name] = body.strip()


def with_ctes(select: str) -> str:
    """Prefix ``select`` with exactly the named subqueries it needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(select)
    parts = [f"{name} AS MATERIALIZED (\n{body}\n)" for name, body in CTES.items() if name in needed]
    select = select.strip()
    if parts and select.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + select[15:]
    if parts and select.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + select[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = with_ctes(sql)
        return function
    return register
