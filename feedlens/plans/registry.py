"""Where plan modules register their queries, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedlens.sources.tables import Reader, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None):
    """Registers a function of a Reader under its own name. covers: the inventory rows it answers."""

    def put(plan: Callable[[Reader], DataFrame]):
        name = plan.__name__
        QUERIES[name] = lambda spark, sf_dir: plan(Reader(spark, sf_dir))
        COVERS[name] = covers
        if sql:
            SQL[name] = with_views(sql)
        return plan

    return put
