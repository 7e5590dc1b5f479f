"""Queries and, where SQL can state them, their DuckDB counterparts, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its double columns are rounded to 6 digits."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f"`{f.name}`", 6).alias(f.name) if f.dataType == T.DoubleType() else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )
