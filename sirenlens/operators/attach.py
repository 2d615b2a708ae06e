"""Joining a small table to very many rows by a key of few values.

A shuffle by such a key would put all rows of a team's busiest week into one task. The small side is
broadcast where its size, measured, allows it; beyond that it is repeated for each of a number of salts,
and the rows are spread over the salts by columns of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the small side, written as JSON text, up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


def attach(rows: DataFrame, small: DataFrame, keys: list[str], spread: list[str], how: str = "left", most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` joined with ``small`` (for a left join at most one row for each of its ``keys``) by ``keys``."""
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= most:
        return rows.join(F.broadcast(small), keys, how)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    placed = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return placed.join(salted, [*keys, "_salt"], how).drop("_salt")
