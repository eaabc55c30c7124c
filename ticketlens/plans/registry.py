"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and,
where the operator is SQL-expressible, the equivalent DuckDB SQL over the same
tables (views named after the driver tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}


def template_sql(template: str, **exprs: str) -> str:
    """DuckDB expression for ``template`` with each ``{name}`` replaced by an expression."""
    import re
    parts = re.split(r"(\{\w+\}|\n)", template)
    out = ["chr(10)" if p == "\n" else exprs[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else "'" + p.replace("'", "''") + "'"
           for p in parts if p]
    return "(" + " || ".join(out) + ")"


def query(name: str, oracle: str | None = None, covers: list[str] | None = None):
    """Register ``fn`` under ``name``; ``covers`` lists the SURVEY §2 operator ids it exercises."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        OPERATORS[name] = list(covers or [])
        return fn
    return deco
