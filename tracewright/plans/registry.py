"""Registered queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (also inside arrays) so that two engines can be compared by value."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, DoubleType):
            c = F.transform(c, lambda x: F.round(x, digits))
        cols.append(c.alias(f.name))
    return df.select(*cols)
