"""Where modules of queries register them, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def km(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


def ms(c: str, name: str) -> Column:
    return F.unix_millis(c).alias(name)
