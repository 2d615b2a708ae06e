"""The rows of every run, once and narrow.

The first of two passes over the events judges each row (rules, panels, clearing) and keeps what
the facts count by: an identity, a day, an instant, a mask, the leaves, a scope. Everything that is
counted reads that table. The wide columns are fetched in the second pass, and only for the few rows
that show something: the newest of each identity and the first of each of its findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions.text import is_blank
from sirenlens.operators import suppression as V
from sirenlens.operators.episodes import is_clear
from sirenlens.operators.identity import ID, REPRESENTATIVE_COLUMNS
from sirenlens.operators.rules import ROW_RULES, evidence, mask_ids, with_rule_mask

c = F.col
#: A place in row order, an instant and then the row's number, as one exact number of fixed width, so that
#: the least one is found by a hash aggregate.
_STEP, _HALF = 2 * 10**19, 1 << 63
EXACT = "decimal(38,0)"


def narrow_rows(scoped: DataFrame, plans: DataFrame) -> DataFrame:
    """Each owned row with its judgement and without its texts."""
    marked = V.mark_visibility(with_rule_mask(scoped), plans)
    return marked.select(
        "team_id", *ID, "snapshot_date", "ts", "seq", "rule_mask", "hit_leaves", "hidden",
        is_clear().alias("clear"),
        F.coalesce("component", F.lit("")).alias("component"),
        F.when(~is_blank(c("node_name")), c("node_name")).alias("node"),
    )


def place() -> Column:
    return F.expr(
        f"CAST(CAST(unix_micros(ts) AS DECIMAL(17,0)) * {_STEP}BD + (CAST(seq AS DECIMAL(20,0)) + {_HALF}BD) AS {EXACT})"
    )


def newest(rows: DataFrame) -> DataFrame:
    """``team_id, identity, ts`` of each identity's last instant."""
    return rows.groupBy("team_id", *ID).agg(F.max("ts").alias("ts"))


def first_findings(rows: DataFrame) -> DataFrame:
    """``identity, rule_id, matched_rows, first_ts, first_seq``: how many rows of an identity a row rule
    matches, and the first of them."""
    found = rows.where("rule_mask <> 0").select(
        *ID, F.explode(mask_ids(c("rule_mask"), ROW_RULES)).alias("rule_id"), place().alias("place")
    )
    counted = found.groupBy(*ID, "rule_id").agg(F.count("*").alias("matched_rows"), F.min("place").alias("place"))
    return with_place(counted)


def with_place(counted: DataFrame) -> DataFrame:
    """``place`` as the instant and the number that it stands for."""
    us = F.expr(f"place div {_STEP}BD")
    seq = F.expr(f"CAST(CAST(place % {_STEP}BD AS DECIMAL(21,0)) - {_HALF}BD AS BIGINT)")
    return counted.select(*ID, "rule_id", "matched_rows", F.timestamp_micros(us).alias("first_ts"), seq.alias("first_seq"))


def shown_rows(scoped: DataFrame, last: DataFrame, first: DataFrame) -> DataFrame:
    """The wide rows that stand at the newest instant of their identity, or at the first of a finding.

    A filter by the instant alone moves down to the source's own columns, which a join by identity cannot:
    wide columns and document hashes are made only for rows of such an instant.
    """
    instants = last.select(*ID, "ts").union(first.select(*ID, c("first_ts").alias("ts"))).distinct()
    kept = [n for n in REPRESENTATIVE_COLUMNS if n != "ts"]
    wide = scoped.select("team_id", *ID, "ts", "seq", *kept)
    near = wide.sparkSession.sql(
        "SELECT * FROM {wide} WHERE ts IN (SELECT ts FROM {instants})", wide=wide, instants=instants
    )
    return near.join(instants, [*ID, "ts"], "left_semi")


def representatives_of(shown: DataFrame, last: DataFrame) -> DataFrame:
    """The newest row of each identity; ties go to the smallest document hash.

    Only rows at the newest instant are ranked, and a map task keeps one of each identity's.
    """
    tied = shown.join(last.select(*ID, "ts"), [*ID, "ts"], "left_semi")
    order = Window.partitionBy("team_id", *ID).orderBy("doc_hash", "seq")
    best = tied.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    flat = best.select("team_id", *ID, *REPRESENTATIVE_COLUMNS)
    return with_rule_mask(flat).withColumnRenamed("rule_mask", "rep_mask").drop("created_us")


def evidence_of(shown: DataFrame, first: DataFrame) -> DataFrame:
    """``identity, rule_id, matched_rows, first_ts, evidence``: the evidence of each finding's first row."""
    wanted = first.withColumnsRenamed({"first_ts": "ts", "first_seq": "seq"})
    rows = with_rule_mask(shown.join(wanted, [*ID, "ts", "seq"]))
    said = rows.select(
        *ID, "rule_id", "matched_rows", c("ts").alias("first_ts"), evidence(c("rule_id"), c("created_us")).alias("evidence")
    )
    return said.distinct()  # rows of one number are copies
