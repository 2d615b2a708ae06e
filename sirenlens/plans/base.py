"""How a query is registered: a callable over (spark, sf_dir) and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def us(name: str, alias: str | None = None) -> Column:
    """An instant as microseconds, comparable in any engine."""
    return F.unix_micros(name).alias(alias or f"{name}_us")


def day(name: str = "snapshot_date") -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def n(*names: str) -> list[Column]:
    """Counts as BIGINT."""
    return [F.col(x).cast("long").alias(x) for x in names]
