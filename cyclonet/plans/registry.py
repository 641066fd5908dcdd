"""Pairs of a query and its SQL, with the columns of the result; doubles are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], keys: str, doubles: str = "", ctes: str = "", body: str | None = None) -> None:
    """keys and doubles: the result's columns, blank-separated; body: SQL over the tables and the ctes."""
    exact, real = keys.split(), doubles.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir).select(*exact, *((F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0)).alias(c) for c in real))

    QUERIES[name] = query
    if body is not None:
        head = f"WITH {ctes} " if ctes else ""
        columns = ", ".join([*exact, *(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in real)])
        ORACLE_SQL[name] = f"{head}SELECT {columns} FROM ({body}) AS result"
