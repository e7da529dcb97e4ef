"""Registry of the queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isograd.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    query: Query
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query and the SQL that gives the same rows."""
    def register(query: Query) -> Query:
        CASES[name] = Case(query, with_views(sql, *views) if sql and views else sql)
        return query

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round columns whose last bits depend on the order of additions."""
    return df.withColumns({c: F.round(c, digits) for c in columns})
