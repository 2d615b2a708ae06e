"""Helpers of the operators: reading tables, batch sizes, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens import session
from sirenlens.session import tune

#: Spark's own setting: the shuffle files of a query go when it ends, not when garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows and bytes of an Arrow batch: documents can be long, so a batch holds few.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in BATCH.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """The cluster's own measure of how finely to cut."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back; the disk of its shuffles is
    free when the write ends. Only the write is under that setting, and it plans ``df`` anew, so no
    other query loses files. Calls follow each other: the setting is the session's."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return session.materialize(df, name)
    finally:
        conf.set(CLEANUP, before)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; the root is the smallest node.

    Alternates large-star and small-star (every node hands its neighbours to its smallest one)
    until nothing changes. A hot node is only ever grouped by a partial ``min``. Each step is a
    written table, so lineage stays short and a lost executor costs one step. Self loops and nulls
    are ignored; no edges give no rows.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a")
        if small:  # a > b: the node itself goes to its smallest neighbour as well
            kept = moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            kept = kept.unionByName(least.select("a", F.col("m").alias("b")))
        else:  # only larger neighbours move
            kept = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return kept.distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(
            e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        )

    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = materialize(edges.distinct(), "edges")
    before = state(current)
    while before[0]:
        current = materialize(star(current, small=False), "edges")
        current = materialize(star(current, small=True), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
