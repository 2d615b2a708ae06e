"""Alert identities: representative row, per-day facts, roll-up and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.text import sort_rules
from sirenlens.operators.episodes import fire_pattern, pattern_evidence
from sirenlens.operators.rules import (
    READINESS_MASK,
    ROW_RULES,
    completion_ready,
    has_rule,
    mask_ids,
    row_findings,
    with_rule_mask,
)
from sirenlens.sources.schema import IDENTITY

c = F.col
ID = list(IDENTITY)

REPRESENTATIVE_COLUMNS = (
    "message",
    "severity",
    "component",
    "operator",
    "node_name",
    "network",
    "environment",
    "site",
    "provider",
    "alert_rule_url",
    "status",
    "impact",
    "impact_kind",
    "runbook_url",
    "runbook_kind",
    "time_created",
    "ts",
    "raw",
    "doc_hash",
)


def group_by_identity(scoped: DataFrame) -> DataFrame:
    return scoped.groupBy(*ID).agg(
        F.count("*").alias("row_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def representatives(scoped: DataFrame) -> DataFrame:
    """The newest row of each identity; ties go to the smallest document hash.

    A min_by aggregate, not a ranking: each map task reduces its rows to one candidate per
    identity before anything is shuffled, also when one identity (or one group of copies at
    the same instant) holds most of the rows.
    """
    order = F.struct((-F.unix_micros("ts")).alias("age"), c("doc_hash"))
    best = scoped.groupBy("team_id", *ID).agg(
        F.min_by(F.struct(*REPRESENTATIVE_COLUMNS), order).alias("r")
    )
    flat = best.select("team_id", *ID, "r.*")
    return with_rule_mask(flat).withColumnRenamed("rule_mask", "rep_mask").drop("created_us")


def judged_firing(facts: DataFrame, reps: DataFrame) -> DataFrame:
    """Episode facts with the pattern, judged by the representative's provider."""
    return facts.join(reps.select(*ID, "provider"), ID).withColumn(
        "fire_pattern", fire_pattern(c("provider"))
    ).drop("provider")


def identity_days(resolved: DataFrame, firing: DataFrame) -> DataFrame:
    """One row per identity and UTC date: rows, flagged, suppressed, unseen, rows per rule."""
    patterns = firing.where(c("fire_pattern").isNotNull()).select(*ID, "fire_pattern")
    joined = resolved.join(patterns, ID, "left")
    firing_row = c("fire_pattern").isNotNull()
    flagged = c("core_row") | c("suppressed") | firing_row
    rules = [
        F.sum(F.when(has_rule(c("rule_mask"), r), c("n")).otherwise(0)).alias(r) for r in ROW_RULES
    ]
    return joined.groupBy("team_id", *ID, "snapshot_date").agg(
        F.sum("n").alias("rows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum(F.when(flagged, c("n")).otherwise(0)).alias("flagged"),
        F.sum(F.when(c("suppressed"), c("n")).otherwise(0)).alias("suppressed"),
        F.sum(F.when(c("unseen"), c("n")).otherwise(0)).alias("unseen"),
        F.max("has_panel").alias("has_panel"),
        *rules,
        F.sum(F.when(c("suppressed"), c("n")).otherwise(0)).alias("R5"),
        F.sum(F.when(firing_row, c("n")).otherwise(0)).alias("R6"),
        F.min(F.when(c("suppressed"), c("first_ts"))).alias("first_suppressed"),
    )


def rule_ids(counts: dict[str, Column], rules: tuple[str, ...]) -> Column:
    """Ids of the rules with a positive count, in rule order."""
    return F.array_compact(F.array(*[F.when(counts[r] > 0, F.lit(r)) for r in rules]))


def identities(days: DataFrame, reps: DataFrame, firing: DataFrame) -> DataFrame:
    """One row per identity. Core rules are the union over its rows; readiness rules come from
    the representative alone."""
    rolled = days.groupBy("team_id", *ID).agg(
        F.sum("rows").alias("row_count"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
        F.count("*").alias("present_days"),
        F.max("has_panel").alias("has_panel"),
        F.sum("unseen").alias("unseen_rows"),
        F.min("first_suppressed").alias("first_suppressed"),
        *[F.sum(r).alias(r) for r in K.ALL_RULES],
    )
    facts = firing.select(
        *ID,
        "clear_count",
        "max_clear_cycles_24h",
        "max_episode_firing_rows",
        "open_us",
        "open_span_us",
        "span_us",
        "events_per_24h",
        "fire_pattern",
    )
    core = rule_ids({r: c(r) for r in K.CORE_RULES}, K.CORE_RULES)
    joined = rolled.join(reps.drop("team_id"), ID).join(facts, ID)
    return (
        joined.withColumn("core_ids", core)
        .withColumn("readiness_ids", mask_ids(c("rep_mask"), K.READINESS_RULES))
        .withColumn("has_core_finding", F.size("core_ids") > 0)
        .withColumn("llm_eligible", F.size("core_ids") == 0)
        .withColumn("unseen", F.when(c("has_panel"), c("unseen_rows") > 0))
        .withColumn(
            "ready",
            F.when(c("alert_schema") == "v2", completion_ready(c("rep_mask"), c("severity"))),
        )
        .withColumnRenamed("ts", "representative_at")
    )


def has_gap() -> Column:
    return (c("alert_schema") == "v2") & (c("rep_mask").bitwiseAND(READINESS_MASK) != 0)


def run_readiness(ids: DataFrame) -> DataFrame:
    """Per run: identity counts, share of ready v2 identities and identities with a gap."""
    v2 = c("alert_schema") == "v2"
    return ids.groupBy("team_id", "run_id").agg(
        F.count_if(~v2).alias("v1_identities"),
        F.count_if(v2).alias("v2_identities"),
        F.when(
            F.count_if(v2) > 0,
            F.count_if(c("ready")).cast("double") / F.count_if(v2).cast("double") * 100,
        ).alias("phase2_readiness_pct"),
        F.count_if(has_gap()).alias("phase2_gap_identities"),
        F.count_if(c("llm_eligible")).alias("llm_eligible"),
    )


def rule_evidence(scoped: DataFrame) -> DataFrame:
    """Per identity and row rule: matching rows and the first one's evidence.

    Only rows with a finding are exploded, and they are pre-aggregated before the shuffle.
    """
    found = row_findings(scoped)
    order = F.struct("ts", "seq")
    return found.groupBy(*ID, "rule_id").agg(
        F.count("*").alias("matched_rows"),
        F.min("ts").alias("first_ts"),
        F.min_by("evidence", order).alias("evidence"),
    )


def evidence_rank(rule: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in K.EVIDENCE_ORDER]), rule)


def late_evidence(ids: DataFrame, active: DataFrame) -> DataFrame:
    """R6 (every row of the identity) and R5 (its suppressed rows) in the same shape."""
    r6 = ids.where(c("fire_pattern").isNotNull()).select(
        *ID,
        F.lit("R6").alias("rule_id"),
        c("row_count").alias("matched_rows"),
        c("first_seen").alias("first_ts"),
        pattern_evidence().alias("evidence"),
    )
    panels = active.select("run_id", "alert_schema", "panel_ids")
    r5 = (
        ids.where(c("R5") > 0)
        .join(panels, ["run_id", "alert_schema"])
        .select(
            *ID,
            F.lit("R5").alias("rule_id"),
            c("R5").alias("matched_rows"),
            c("first_suppressed").alias("first_ts"),
            F.to_json(
                F.struct(
                    c("panel_ids").alias("panels"),
                    F.lit("excluded by every supplied panel for this schema").alias("reason"),
                )
            ).alias("evidence"),
        )
    )
    return r6.union(r5)


def evidence_documents(entries: DataFrame) -> DataFrame:
    """The evidence list of each identity (at most one entry per rule) as JSON text, ordered by
    first matching row."""
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "first_ts",
                evidence_rank(c("rule_id")).alias("rank"),
                F.concat(
                    F.lit('{"rule_id":"'),
                    c("rule_id"),
                    F.lit('","matched_rows":'),
                    c("matched_rows").cast("string"),
                    F.lit(',"sample_evidence":'),
                    c("evidence"),
                    F.lit("}"),
                ).alias("text"),
            )
        )
    )
    return entries.groupBy(*ID).agg(
        F.concat(
            F.lit("["), F.array_join(F.transform(ordered, lambda e: e["text"]), ","), F.lit("]")
        ).alias("findings_evidence")
    )


def attach_findings(core_ids: Column, late: Column) -> Column:
    """Core ids after late findings arrive, in rule order."""
    return sort_rules(F.array_union(core_ids, late))
