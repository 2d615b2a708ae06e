"""Daily facts per run, schema and UTC date, and their weekly roll-ups.

Exact distinct counts come from grouping at the distinct grain and counting groups, in a chain
from the finest key up, rather than from several count-distincts over the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.scalars import ratio
from sirenlens.functions.text import is_blank, rule_number

c = F.col
DAY = ["run_id", "alert_schema", "snapshot_date"]


def schema_days(buckets: DataFrame) -> DataFrame:
    """Every (run, schema, date), whether anything fired or not."""
    schemas = F.explode(F.array(*[F.lit(s) for s in K.SCHEMAS]))
    return buckets.withColumn("alert_schema", schemas)


def scope_counts(scoped: DataFrame) -> DataFrame:
    """Per day: rows, distinct (application, component), and the node diagnostic, in which only
    rows with a node name take part on both sides. A NULL component equals an empty one."""
    node = F.when(~is_blank(c("node_name")), c("node_name"))
    named = scoped.withColumn("component", F.coalesce("component", F.lit(""))).withColumn("node", node)
    return counts_of_scopes(scopes_of(named))


def scopes_of(rows: DataFrame) -> DataFrame:
    """Rows per day and scope: application, component and node (NULL without a name)."""
    return rows.groupBy(*DAY, "application", "component", "node").agg(F.count("*").alias("n"))


def counts_of_scopes(finest: DataFrame) -> DataFrame:
    scopes = finest.groupBy(*DAY, "application", "component").agg(
        F.sum("n").alias("n"), F.count("node").alias("nodes")
    )
    return scopes.groupBy(*DAY).agg(
        F.sum("n").alias("alerts"),
        F.count("*").alias("key_inflation_denominator"),
        F.sum("nodes").alias("node_name_numerator"),
        F.count_if(c("nodes") > 0).alias("node_name_denominator"),
    )


def distinct_counts(identity_days: DataFrame) -> DataFrame:
    return identity_days.groupBy(*DAY).agg(F.count("*").alias("distinct_alerts"))


def daily_volume(buckets: DataFrame, scope_days: DataFrame, identity_days: DataFrame) -> DataFrame:
    """Volume of every bucket, empty buckets kept, from the ``scope_counts`` of the rows."""
    counts = ("alerts", "distinct_alerts", "node_name_numerator", "node_name_denominator",
              "key_inflation_denominator")
    joined = (
        schema_days(buckets)
        .join(scope_days, DAY, "left")
        .join(distinct_counts(identity_days), DAY, "left")
    )
    filled = joined.fillna(0, subset=list(counts))
    return filled.select(
        "run_id",
        "team_id",
        "alert_schema",
        "snapshot_date",
        "bucket_start",
        "bucket_end",
        "covered_hours",
        "alerts",
        "distinct_alerts",
        (c("alerts") / c("covered_hours")).alias("alerts_per_hour"),
        "node_name_numerator",
        "node_name_denominator",
        ratio(c("node_name_numerator"), c("node_name_denominator")).alias("node_name_ratio"),
        c("distinct_alerts").alias("key_inflation_numerator"),
        "key_inflation_denominator",
        ratio(c("distinct_alerts"), c("key_inflation_denominator")).alias("key_inflation_ratio"),
    )


def plain_identity_days(scoped: DataFrame) -> DataFrame:
    """(identity, date) pairs, for volume without the rule pass."""
    return scoped.groupBy("team_id", *DAY, "application", "key_field").agg(
        F.count("*").alias("rows")
    )


def daily_rule_counts(identity_days: DataFrame) -> DataFrame:
    """Matching rows and identities per (date, rule): rows count on their own date only."""
    entries = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule_id"), c(r).alias("m")) for r in K.ALL_RULES])
    )
    return (
        identity_days.select("team_id", *DAY, entries.alias("e"))
        .where(c("e.m") > 0)
        .groupBy("team_id", *DAY, c("e.rule_id").alias("rule_id"))
        .agg(F.sum("e.m").alias("match_count"), F.count("*").alias("distinct_count"))
    )


def daily_flagged(identity_days: DataFrame) -> DataFrame:
    return identity_days.groupBy(*DAY).agg(
        F.sum("flagged").alias("flagged_by_rule"),
        F.count_if(c("flagged") > 0).alias("flagged_by_rule_distinct"),
    )


def daily_quality(identity_days: DataFrame, states: DataFrame) -> DataFrame:
    """Identity states projected to every date the identity appears on. ``llm_flagged`` covers
    all its rows; the others count the identity once per date; gaps are independent of state.

    ``states`` is ``(identity, quality_state, gap)``.
    """
    joined = identity_days.join(
        states, ["run_id", "alert_schema", "application", "key_field"]
    )
    state = c("quality_state")
    return joined.groupBy(*DAY).agg(
        F.sum(F.when(state == "llm_flagged", c("rows")).otherwise(0)).alias("flagged_by_llm"),
        F.count_if(state == "llm_flagged").alias("flagged_by_llm_distinct"),
        F.count_if(state == "needs_review").alias("needs_review"),
        F.count_if(state == "assessed_good").alias("assessed_good"),
        F.count_if(state == "unassessed").alias("unassessed"),
        F.count_if(c("gap")).alias("phase2_gaps"),
    )


def daily_visibility(identity_days: DataFrame) -> DataFrame:
    return identity_days.groupBy(*DAY).agg(
        F.sum("suppressed").alias("suppressed"), F.sum("unseen").alias("unseen_seen")
    )


def first_bucket() -> Column:
    """A run-level count sits on the schema's first bucket only, so the column sums once."""
    order = Window.partitionBy("run_id", "alert_schema").orderBy("snapshot_date")
    return F.row_number().over(order) == 1


def daily_metrics(
    volume: DataFrame,
    identity_days: DataFrame,
    states: DataFrame,
    unmeasured: DataFrame,
) -> DataFrame:
    """The complete daily fact: volume, quality and visibility per run, schema and date."""
    zero = F.lit(0)
    joined = (
        volume.join(daily_flagged(identity_days), DAY, "left")
        .join(daily_quality(identity_days, states), DAY, "left")
        .join(daily_visibility(identity_days), DAY, "left")
        .join(unmeasured, ["run_id", "alert_schema"], "left")
        .withColumn("first_bucket", first_bucket())
    )
    has_panel = c("suppression_unmeasured").isNotNull()
    counted = ("flagged_by_rule", "flagged_by_rule_distinct", "flagged_by_llm",
               "flagged_by_llm_distinct", "needs_review", "assessed_good", "unassessed",
               "phase2_gaps", "suppressed")
    once = F.when(c("first_bucket"), F.coalesce("suppression_unmeasured", zero)).otherwise(zero)
    unseen_once = F.when(c("first_bucket"), c("unseen_unmeasured")).otherwise(zero)
    return joined.select(
        *volume.columns,
        *[F.coalesce(name, zero).cast("long").alias(name) for name in counted],
        once.cast("long").alias("suppression_unmeasured"),
        F.when(has_panel, F.coalesce("unseen_seen", zero)).alias("unseen"),
        F.when(has_panel, unseen_once).cast("long").alias("unseen_unmeasured"),
    )


SUMS = (
    "alerts",
    "distinct_alerts",
    "flagged_by_rule",
    "flagged_by_rule_distinct",
    "flagged_by_llm",
    "flagged_by_llm_distinct",
    "needs_review",
    "assessed_good",
    "unassessed",
    "phase2_gaps",
    "suppressed",
    "suppression_unmeasured",
    "node_name_numerator",
    "node_name_denominator",
    "key_inflation_numerator",
    "key_inflation_denominator",
)
VOLUME_SUMS = tuple(
    n for n in SUMS if n.endswith(("numerator", "denominator")) or n in ("alerts", "distinct_alerts")
)


def weekly_volume(volume: DataFrame) -> DataFrame:
    """Row counts sum, distincts become a daily rate over seven days, ratios divide sums."""
    summed = volume.groupBy("run_id", "alert_schema").agg(
        *[F.sum(n).alias(n) for n in VOLUME_SUMS]
    )
    return summed.select(
        "run_id",
        "alert_schema",
        "alerts",
        (c("alerts") / F.lit(float(K.WINDOW_HOURS))).alias("alerts_per_hour"),
        (c("distinct_alerts") / F.lit(float(K.WINDOW_DAYS))).alias("distinct_alerts_per_day"),
        "node_name_numerator",
        "node_name_denominator",
        ratio(c("node_name_numerator"), c("node_name_denominator")).alias("node_name_ratio"),
        "key_inflation_numerator",
        "key_inflation_denominator",
        ratio(c("key_inflation_numerator"), c("key_inflation_denominator")).alias(
            "key_inflation_ratio"
        ),
    )


def weekly_rollup(metrics: DataFrame) -> DataFrame:
    """The scorecard roll-up of the complete daily fact. ``sum`` keeps a NULL that nothing
    measured."""
    summed = metrics.groupBy("run_id", "alert_schema").agg(
        *[F.sum(n).alias(n) for n in (*SUMS, "unseen", "unseen_unmeasured")]
    )
    rates = {
        "distinct_alerts": "distinct_per_day",
        "flagged_by_rule_distinct": "flagged_by_rule_distinct_per_day",
        "flagged_by_llm_distinct": "flagged_by_llm_distinct_per_day",
        "needs_review": "needs_review_per_day",
        "assessed_good": "assessed_good_per_day",
        "unassessed": "unassessed_per_day",
        "phase2_gaps": "phase2_gaps_per_day",
    }
    days = F.lit(float(K.WINDOW_DAYS))
    return summed.select(
        "*",
        (c("alerts") / F.lit(float(K.WINDOW_HOURS))).alias("alerts_per_hour"),
        *[(c(n) / days).alias(alias) for n, alias in rates.items()],
        ratio(c("node_name_numerator"), c("node_name_denominator")).alias("node_name_ratio"),
        ratio(c("key_inflation_numerator"), c("key_inflation_denominator")).alias(
            "key_inflation_ratio"
        ),
    )


def rule_breakdown(rule_counts: DataFrame) -> DataFrame:
    return (
        rule_counts.groupBy("run_id", "alert_schema", "rule_id")
        .agg(
            F.sum("match_count").alias("matching_rows"),
            (F.sum("distinct_count") / F.lit(float(K.WINDOW_DAYS))).alias("distinct_per_day"),
        )
        .orderBy("run_id", "alert_schema", rule_number(c("rule_id")))
    )
