"""Query registry: each entry pairs a Spark plan with the DuckDB text that checks it.

`cols` declares the output once for both engines, as "name:type ..." with the
types s (text), i (bigint), b (boolean as 0/1), d (day as text) and fN (double
rounded to N digits, 6 when N is left out).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelweave.plans.fixtures import VIEW_SQL, Tables

# Named sub-queries available to every oracle; catalog modules add their own.
SHARED_SQL: dict[str, str] = dict(VIEW_SQL)


@dataclass(frozen=True)
class Query:
    name: str
    cols: tuple[tuple[str, str], ...]
    plan: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, cols: str, oracle: str | None = None):
    """Register the decorated function `f(tables) -> DataFrame` under `name`."""
    spec = tuple(tuple(c.split(":")) for c in cols.split())

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, spec, fn, oracle)
        return fn

    return keep


def _nudge(digits: int) -> float:
    """Offset far below the last digit kept, so that exact ties round alike in both engines."""
    return 0.017 * 10.0 ** -digits


def _spark_col(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("int").alias(name)
    if kind[0] == "f":
        n = int(kind[1:] or 6)
        return F.round(c.cast("double") + F.lit(_nudge(n)), n).alias(name)
    return c.cast("string").alias(name)


def _duck_col(name: str, kind: str) -> str:
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "b":
        return f'CAST("{name}" AS INTEGER) AS "{name}"'
    if kind[0] == "f":
        n = int(kind[1:] or 6)
        return f'round(CAST("{name}" AS DOUBLE) + {_nudge(n)!r}, {n}) + 0e0 AS "{name}"'
    return f'CAST("{name}" AS VARCHAR) AS "{name}"'


def shape(df: DataFrame, cols) -> DataFrame:
    return df.select(*[_spark_col(n, k) for n, k in cols])


def _needed(sql: str, seen: list[str]) -> None:
    for name in SHARED_SQL:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(SHARED_SQL[name], seen)
            if name not in seen:
                seen.append(name)


def oracle_text(q: Query) -> str:
    """Full SQL of one oracle: shared sub-queries first, then the shaped body."""
    parts: list[str] = []
    _needed(q.oracle, parts)
    head = ",\n".join(f"{n} AS MATERIALIZED ({SHARED_SQL[n]})" for n in parts)
    select = ", ".join(_duck_col(n, k) for n, k in q.cols)
    body = f"SELECT {select} FROM (\n{q.oracle}\n) AS answer"
    return f"WITH {head}\n{body}" if head else body


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return shape(q.plan(Tables(spark, folder)), q.cols)

        run.__name__ = q.name
        return run

    return {n: bind(q) for n, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    return {n: oracle_text(q) for n, q in REGISTRY.items() if q.oracle is not None}
