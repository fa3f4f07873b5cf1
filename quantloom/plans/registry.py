"""Named queries with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.plans.oracle import with_tables
from quantloom.plans.stage import forget_staged, staged

__all__ = ["ORACLE", "QUERIES", "forget_staged", "query", "rounded", "staged"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_tables(sql.strip())
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, exact: tuple = (), **special: int) -> DataFrame:
    """Doubles rounded for comparison, except the ``exact`` ones; integers as bigint.

    Exact columns come from integer sums by the same few operations on both sides; rounding
    those would meet true ties.
    """
    out = []
    for name, kind in df.dtypes:
        if name in exact:
            out.append(F.col(name))
        elif kind in ("double", "float"):
            x = F.round(F.col(name).cast("double"), special.get(name, digits))
            out.append((x + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
