"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(col: Column | str, digits: int = 6) -> Column:
    """Double rounded half up. Spelled out because engines round exact ties differently."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col.cast("double") * (10.0 ** digits) + 0.5) / (10.0 ** digits)


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``r6``."""
    return f"(floor(cast({expr} as double) * 1e{digits} + 0.5e0) / 1e{digits})"
