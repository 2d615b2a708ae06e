"""Every registered query, imported for its side effect, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sirenlens.plans import queries_facts, queries_published, queries_rows, queries_streams
from sirenlens.plans.base import ORACLES, QUERIES

MODULES = (queries_rows, queries_facts, queries_published, queries_streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["d03_daily_volume"](spark, sf_dir)


__all__ = ["MODULES", "ORACLES", "QUERIES", "flagship"]
