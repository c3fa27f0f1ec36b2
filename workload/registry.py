"""Where queries and their expected-result SQL are collected."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, expected: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if expected:
            EXPECTED[name] = sql(expected)
        return fn

    return add


# Column forms that both engines print alike.


def text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c.split(".")[-1])


def r6(c: str | Column, name: str | None = None) -> Column:
    """Six decimals.  A mean over, say, 32 calls can lie exactly half-way between two of them, where
    the last bit of a sum decides; the same nudge in the SQL settles such cases alike."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col + 1e-9, 6).alias(name or c)


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)
