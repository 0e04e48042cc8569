"""The queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of an amount in hundredths.
CENTS = "CAST(CAST({0} AS DECIMAL(15,2)) * 100 AS BIGINT)"
PRICE_SQL, BALANCE_SQL, TOTAL_SQL = (CENTS.format(c) for c in ("l_extendedprice", "c_acctbal", "o_totalprice"))


def query(sql: str | None):
    """Register a query, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(x: str | Column, shape: str = "decimal(15,2)") -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(shape)


def cents(x: Column) -> Column:
    return (x * 100).cast("bigint")


def field(name: str, **k) -> dict:
    """A field of a version 2 layout."""
    return {"kind": "field", "name": name, **k}
