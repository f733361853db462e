"""Query registration and SQL composition for the check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(name: str, sql: str) -> None:
    """Named SQL relation that checks can build on."""
    VIEWS[name] = sql.strip()


def compose(sql: str) -> str:
    """Prefix the views a statement refers to, in dependency order.

    Rounded values get 0 added so that no negative zero is left.
    """
    return re.sub(
        r"round_even\(([^()]*), (\d)\)", r"(0.0::DOUBLE + round_even(\1, \2))", _with_views(sql)
    )


def _with_views(sql: str) -> str:
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in VIEWS and word not in order and VIEWS[word] is not text:
                visit(VIEWS[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(key: str, sql: str | None = None):
    """Register a query and, when SQL can express it, its check."""

    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
