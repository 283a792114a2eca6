"""The table of queries: name, function of (spark, sf_dir), and SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; its doubles are rounded to nine places, as its SQL's are."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Sums of doubles depend on their order in the last places."""
    doubles = {c: positive_zero(F.round(F.col(c), digits)).alias(c) for c, kind in df.dtypes if kind == "double"}
    return df.select(*[doubles.get(c, F.col(c)) for c in df.columns])


def positive_zero(x: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x)
