"""Registry of queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rounded(name: str) -> str:
    return f"round(CAST({name} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


def shape(df: DataFrame, cols: str) -> DataFrame:
    """The columns of ``cols``; those marked ``~`` are doubles, rounded to six places."""
    return df.select(*[F.expr(_rounded(c[1:])) if c[0] == "~" else F.col(c) for c in cols.split()])


def query(name: str, cols: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query returning ``cols``, and its oracle built from ``sql`` over ``views``."""

    def wrap(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), cols)
        if sql is not None:
            final = ", ".join(_rounded(c[1:]) if c[0] == "~" else c for c in cols.split())
            body = f"SELECT {final} FROM (\n{sql.strip()}\n) AS result"
            ORACLES[name] = with_views(views, body) if views else body
        return fn

    return wrap
