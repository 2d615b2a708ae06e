"""A training-corpus pipeline: language ID, line dedup, near duplicates, decontamination, mixing.

Each stage takes what its predecessor kept, with the columns of ``documents``, and is written as
Parquet before the next one reads it, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.llm import decontaminate, jaccard, langid, lines, mixing
from sirenlens.llm.common import materialize, prepared, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document goes when its best language has less than this posterior, or when it has no letters.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, learned from the labelled ones outside the held-out fold."""
    prepared(spark)
    return langid.known_only(docs, langid.train(docs.where(~langid.held_out())), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source are cut from its texts; every document stays."""
    prepared(spark)
    cut = lines.drop_boilerplate(docs, host="source")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last, then
    the smallest text hash. Of rows repeated with one id and text the one with the smallest source and
    language stays. Documents without words are in no group."""
    prepared(spark)
    groups = materialize(jaccard.represented(docs), "pipeline-groups")
    surplus = groups.where(~F.col("is_first"))
    surplus = surplus.select(F.col("doc_id").alias("_dup_id"), F.col("h").alias("_dup_h")).distinct()
    surplus = materialize(surplus, "pipeline-surplus")
    same = (F.xxhash64("text") == F.col("_dup_h")) & F.col("doc_id").eqNullSafe(F.col("_dup_id"))
    kept = docs.join(surplus, same, "left_anti")
    repeated = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = sorted(others, key=("source", "lang", *others).index)
    once = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*order)).alias("_rep"))
    return once.select(*[F.col(f"_rep.{c}" if c in order else c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_items(docs, table(prepared(spark), sf_dir, "benchmark"))


#: Columns that mixing adds, in place of columns of these names.
ADDED = ("size", "source_size", "target", "copies", "taken")


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with their ``copies`` and words ``taken``.

    Rows equal in id, source and text are one row with all their copies.
    """
    prepared(spark)
    sums = [F.sum(n).alias(f"_mix_{n}") for n in ("copies", "taken")]
    same_for_all = [F.first(n).alias(f"_mix_{n}") for n in ("size", "source_size", "target")]
    wanted = (
        mixing.mix_to_targets(docs)
        .groupBy(F.col("doc_id").alias("_mix_id"), F.col("key").alias("_mix_key"))
        .agg(*sums, *same_for_all, F.count("*").alias("_mix_rows"))
        .where("_mix_copies > 0")
    )
    wanted = materialize(wanted, "pipeline-mix")
    key = F.xxhash64("doc_id", "source", "text")
    taken = docs.join(wanted, (key == F.col("_mix_key")) & F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    # only rows that are repeated move once more
    repeated = taken.where("_mix_rows > 1").dropDuplicates(["_mix_id", "_mix_key"])
    once = taken.where("_mix_rows = 1").unionByName(repeated)
    kept = [n for n in docs.columns if n not in ADDED]
    return once.select(*kept, *[F.col(f"_mix_{n}").alias(n) for n in ADDED])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_targets),
]

#: SQL cannot score languages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
