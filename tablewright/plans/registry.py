"""The registered queries, each with the SQL that gives the same rows.

A query takes a workspace over the given tables and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.query import Query
from tablewright.plans.driver_tables import workspace

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None, name: str = ""):
    """Register a function of a workspace under its own name or `name`."""

    def register(build):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            result = build(workspace(spark, folder))
            return result.frame() if isinstance(result, Query) else result

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return build

    return register
