"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def dated(columns: str, *names: str) -> None:
    """Give dates of these columns as ISO text, in queries and SQL alike."""
    from functools import wraps

    from pyspark.sql import functions as F

    for name in names:

        def as_text(spark, sf_dir, f=QUERIES[name]):
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in columns.split()})

        QUERIES[name] = wraps(QUERIES[name])(as_text)
        if name in SQL:
            SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns.split())}) FROM ({SQL[name]})"
