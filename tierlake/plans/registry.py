"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return run

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round floating columns so that the order of additions does not show."""
    return df.withColumns({c: F.round(c, places) for c in columns})
