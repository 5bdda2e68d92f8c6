"""Registered queries: a Spark function and, where SQL can say it, its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
# SQL bodies of the derived views, by name.
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _uses(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"(?i)\b(from|join)\s+{n}\b", sql)]


def with_views(sql: str) -> str:
    """The query with every derived view it needs in front, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _uses(text):
            if n not in order:
                need(VIEWS[n])
                if n not in order:
                    order.append(n)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in order)
    head, rest = ("WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"), sql.strip()
    if re.match(r"(?i)with\s+", rest):
        rest = re.sub(r"(?i)^with\s+(recursive\s+)?", "", rest)
        return f"{head} {ctes},\n{rest}"
    return f"{head} {ctes}\n{rest}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracles() -> dict[str, str]:
    return {k: with_views(v) for k, v in ORACLES.items()}
