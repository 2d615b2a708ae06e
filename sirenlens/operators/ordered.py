"""Ranks and running sums over groups of any size.

A plain window puts each group in one task. Here all rows are range-partitioned once by group and
order, so a partition is an ordered piece of one group or of several; ranks are computed inside
each piece of a group and shifted by the totals of the pieces before it. The placed rows are
written, since the cut points come from a sample: every later step must see the same pieces. The
result is exact and does not depend on where the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.session import materialize

c = F.col


def with_running(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] | None = None
) -> DataFrame:
    """Add ``rank`` (1-based), ``group_size`` and, per ``sums`` entry ``{out: column}``, the
    inclusive running sum ``out`` and the group's total ``out_total``.

    ``order`` must make every row of a group distinct. Ascending only: negate a number to order
    it downwards.
    """
    sums = sums or {}
    keyed = df.withColumn("_order", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    ranged = keyed.repartitionByRange(*keys, "_order").withColumn("_piece", F.spark_partition_id())
    placed = materialize(ranged, "ordered")
    totals = placed.groupBy(*keys, "_piece").agg(
        F.count("*").alias("_n"), *[F.sum(col).alias(f"_t_{out}") for out, col in sums.items()]
    )
    # one row for each piece of a group
    line = Window.partitionBy(*keys).orderBy("_piece")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *[c(k).alias(f"_k_{k}") for k in keys],
        c("_piece").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("group_size"),
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_s_{out}") for out in sums],
        *[F.sum(f"_t_{out}").over(whole).alias(f"{out}_total") for out in sums],
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy("_order")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        "*",
        F.row_number().over(inside).alias("_r0"),
        *[F.sum(col).over(running).alias(f"_l_{out}") for out, col in sums.items()],
    )
    same = c("_piece") == c("_p")
    for k in keys:
        same &= c(k).eqNullSafe(c(f"_k_{k}"))
    return local.join(offsets, same).select(
        *df.columns,
        (c("_r0") + c("_n0")).alias("rank"),
        "group_size",
        *[(c(f"_l_{out}") + c(f"_s_{out}")).alias(out) for out in sums],
        *[f"{out}_total" for out in sums],
    )
