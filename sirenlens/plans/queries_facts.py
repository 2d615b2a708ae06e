"""Registered queries: identities, daily facts, firing episodes, panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.operators import episodes as E
from sirenlens.operators import identity as I
from sirenlens.operators import insights as N
from sirenlens.operators import suppression as V
from sirenlens.operators import volume as D
from sirenlens.operators import window as Wn
from sirenlens.plans import sample
from sirenlens.plans.base import day, n, query, us
from sirenlens.plans.oracle import ID as ID_SQL
from sirenlens.plans.oracle import iso, norm_field, norm_message, sql
from sirenlens.plans.store import stored, weekly_analysis, window_analysis
from sirenlens.plans.team_week import states_of
from sirenlens.sources.events import alerts_from_events
from sirenlens.sources.registry import Registry

c = F.col
ID = I.ID
FAN = sample.FAN


# ------------------------------------------------------------------ identities


@query("a01_group_by_identity", sql(f"SELECT {ID_SQL}, count(*) AS row_count, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us FROM scoped GROUP BY ALL", "wide"))
def a01(spark: SparkSession, sf: str) -> DataFrame:
    grouped = I.group_by_identity(window_analysis(spark, sf, FAN).scoped)
    return grouped.select(*ID, "row_count", us("first_seen"), us("last_seen"))


@query("a02_representative", sql(f"SELECT {ID_SQL}, doc_hash, epoch_us(ts) AS ts_us, severity, node_name FROM reps", "wide"))
def a02(spark: SparkSession, sf: str) -> DataFrame:
    return window_analysis(spark, sf, FAN).representatives.select(*ID, "doc_hash", us("ts"), "severity", "node_name")


@query("a03_identity_rollup", sql(f"SELECT {ID_SQL}, CAST(row_count AS BIGINT) AS row_count, epoch_us(first_seen) AS first_seen_us, epoch_us(last_seen) AS last_seen_us, present_days, core_rule_ids, readiness_rule_ids, unseen FROM ids", "wide"))
def a03(spark: SparkSession, sf: str) -> DataFrame:
    ids = window_analysis(spark, sf, FAN).identities
    return ids.select(
        *ID, *n("row_count"), us("first_seen"), us("last_seen"), *n("present_days"),
        F.array_join("core_ids", ",").alias("core_rule_ids"),
        F.array_join("readiness_ids", ",").alias("readiness_rule_ids"), "unseen",
    )


#: The evidence of a row for the rule that it matches, as JSON text.
_SAID = f"""CASE WHEN rule_id IN ('R1', 'R2') THEN '{{"field":"message","normalized":"' || {norm_message('message')} || '"}}'
WHEN rule_id = 'R3' THEN '{{"violations":[{{"field":"' || CASE alert_schema WHEN 'v2' THEN 'component' ELSE 'object' END || '","reason":"placeholder","normalized":"' || {norm_field('component')} || '"}}]}}'
WHEN rule_id = 'R4' THEN '{{"provider":"' || provider || '","alert_rule_url":null}}'
WHEN rule_id = 'R7' THEN '{{"reason":"' || r7_reason || '","time_created":' || CASE WHEN time_created IS NULL THEN 'null' ELSE '"' || time_created || '"' END || CASE WHEN r7_reason IN ('future', 'older_than_24h') THEN ',"timestamp":"' || {iso('ts')} || '"' ELSE '' END || '}}'
WHEN rule_id = 'R8' THEN '{{"reason":"' || r8_reason || '"}}'
WHEN rule_id = 'R9' THEN '{{"severity":"' || severity || '","blocks_completion":' || CASE severity WHEN 'critical' THEN 'true' ELSE 'false' END || ',"reason":"' || r9_reason || '"}}'
ELSE '{{"field":"impact","normalized":"' || {norm_message('impact')} || '"}}' END"""
_FOUND = " UNION ALL ".join(
    f"SELECT *, '{r}' AS rule_id FROM judged WHERE {r.lower()} > 0"
    for r in ("R1", "R2", "R3", "R4", "R7", "R8", "R9", "R10")
)


@query("a04_rule_evidence", sql(f"SELECT {ID_SQL}, rule_id, count(*) AS matched_rows, epoch_us(min(ts)) AS first_us, first(evidence ORDER BY ts, seq) AS evidence FROM (SELECT *, {_SAID} AS evidence FROM ({_FOUND}) y) x GROUP BY ALL", "wide"))
def a04(spark: SparkSession, sf: str) -> DataFrame:
    found = window_analysis(spark, sf, FAN).evidence
    return found.select(*ID, "rule_id", "matched_rows", us("first_ts", "first_us"), "evidence")


@query("a04_evidence_document", sql(f"SELECT {ID_SQL}, len(string_split(all_ids, ',')) - CAST(all_ids = '' AS INT) AS at_least FROM ranked", "weekly"))
def a04b(spark: SparkSession, sf: str) -> DataFrame:
    f = stored(spark, sf).store.alert_findings
    entries = F.from_json("findings_evidence", "array<struct<rule_id:string,matched_rows:long>>")
    listed = F.concat_ws(",", "core_rule_ids", "readiness_rule_ids")
    wanted = F.filter(F.split(listed, ","), lambda r: r != "")
    # readiness evidence also covers older rows, so only the attached rules are counted
    kept = F.filter(entries, lambda e: F.array_contains(wanted, e["rule_id"]))
    return f.select(*ID, F.size(kept).cast("long").alias("at_least"))


@query("a05_classifier_eligible", sql(f"SELECT {ID_SQL}, core_rule_ids = '' AS eligible FROM ids", "weekly"))
def a05(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_analysis(spark, sf).identities.select(*ID, c("llm_eligible").alias("eligible"))


@query("a06_late_findings", sql(f"SELECT {ID_SQL}, core_rule_ids FROM ids WHERE r5 > 0", "wide"))
def a06(spark: SparkSession, sf: str) -> DataFrame:
    ids = window_analysis(spark, sf, FAN).identities.where(c("R5") > 0)
    before = F.array_except("core_ids", F.array(F.lit("R5")))
    attached = I.attach_findings(before, F.array(F.lit("R5")))
    return ids.select(*ID, F.array_join(attached, ",").alias("core_rule_ids"))


@query("a07_quality_state", sql(f"SELECT {ID_SQL}, quality_state, unassessed_reason FROM findings", "weekly"))
def a07(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).store.alert_findings.select(*ID, "quality_state", "unassessed_reason")


@query("a08_gap_identities", sql("SELECT run_id, phase2_gap_identities FROM run_facts WHERE v1_identities + v2_identities > 0", "wide"))
def a08(spark: SparkSession, sf: str) -> DataFrame:
    return I.run_readiness(window_analysis(spark, sf, FAN).identities).select("run_id", "phase2_gap_identities")


# ------------------------------------------------------------------ daily facts


@query("d01_day_buckets", sql("SELECT b.run_id, CAST(CAST(b.snapshot_date AS DATE) AS VARCHAR) AS snapshot_date, epoch_us(bucket_start) AS bucket_start_us, epoch_us(bucket_end) AS bucket_end_us, covered_hours, count(s.seq) AS rows FROM buckets b LEFT JOIN scoped s ON s.run_id = b.run_id AND s.ts >= bucket_start AND s.ts < bucket_end GROUP BY ALL"))
def d01(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    buckets = Wn.day_buckets(a.runs)
    rows = a.scoped.groupBy("run_id", "snapshot_date").agg(F.count("*").alias("rows"))
    return buckets.join(rows, ["run_id", "snapshot_date"], "left").select(
        "run_id", day(), us("bucket_start"), us("bucket_end"), "covered_hours",
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )


@query("d02_window_containment", "SELECT event_id, ts >= TIMESTAMP '2024-01-08 18:00:00' AND ts < TIMESTAMP '2024-01-15 18:00:00' AS inside FROM events")
def d02(spark: SparkSession, sf: str) -> DataFrame:
    start, end = Wn.span_of(sample.window_specs())
    inside = Wn.in_window(c("ts"), F.lit(start), F.lit(end))
    return alerts_from_events(spark, sf).select(c("seq").alias("event_id"), inside.alias("inside"))


def _volume(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    return D.daily_volume(Wn.day_buckets(a.runs), D.scope_counts(a.scoped), D.plain_identity_days(a.scoped))


@query("d03_daily_volume", sql("SELECT run_id, team_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, covered_hours, alerts, distinct_alerts, alerts_per_hour FROM volume"))
def d03(spark: SparkSession, sf: str) -> DataFrame:
    return _volume(spark, sf).select("run_id", "team_id", "alert_schema", day(), "covered_hours", "alerts", "distinct_alerts", "alerts_per_hour")


@query("d04_node_diagnostic", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, node_name_numerator, node_name_denominator, node_name_ratio FROM volume"))
def d04(spark: SparkSession, sf: str) -> DataFrame:
    return _volume(spark, sf).select("run_id", "alert_schema", day(), "node_name_numerator", "node_name_denominator", "node_name_ratio")


@query("d05_key_inflation", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, key_inflation_numerator, key_inflation_denominator, key_inflation_ratio FROM volume"))
def d05(spark: SparkSession, sf: str) -> DataFrame:
    return _volume(spark, sf).select("run_id", "alert_schema", day(), "key_inflation_numerator", "key_inflation_denominator", "key_inflation_ratio")


@query("d06_weekly_volume", sql("SELECT run_id, alert_schema, CAST(sum(alerts) AS BIGINT) AS alerts, sum(alerts) / 168.0::DOUBLE AS alerts_per_hour, sum(distinct_alerts) / 7.0::DOUBLE AS distinct_alerts_per_day, CAST(sum(node_name_numerator) AS DOUBLE) / nullif(sum(node_name_denominator), 0) AS node_name_ratio, CAST(sum(key_inflation_numerator) AS DOUBLE) / nullif(sum(key_inflation_denominator), 0) AS key_inflation_ratio FROM volume GROUP BY ALL"))
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return D.weekly_volume(_volume(spark, sf)).select("run_id", "alert_schema", "alerts", "alerts_per_hour", "distinct_alerts_per_day", "node_name_ratio", "key_inflation_ratio")


@query("d06_scorecard_rollup", sql("SELECT run_id, alert_schema, CAST(sum(flagged_by_rule) AS BIGINT) AS flagged_by_rule, sum(flagged_by_rule_distinct) / 7.0::DOUBLE AS flagged_by_rule_distinct_per_day, sum(needs_review) / 7.0::DOUBLE AS needs_review_per_day, CAST(sum(suppressed) AS BIGINT) AS suppressed, CAST(sum(unseen) AS BIGINT) AS unseen, CAST(sum(unseen_unmeasured) AS BIGINT) AS unseen_unmeasured FROM metrics GROUP BY ALL", "weekly"))
def d06b(spark: SparkSession, sf: str) -> DataFrame:
    return D.weekly_rollup(stored(spark, sf).store.daily_metrics).select(
        "run_id", "alert_schema", "flagged_by_rule", "flagged_by_rule_distinct_per_day",
        "needs_review_per_day", "suppressed", "unseen", "unseen_unmeasured",
    )


@query("d07_daily_rule_counts", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, rule_id, CAST(match_count AS BIGINT) AS match_count, distinct_count FROM rule_days"))
def d07(spark: SparkSession, sf: str) -> DataFrame:
    counts = D.daily_rule_counts(window_analysis(spark, sf).identity_days)
    return counts.select("run_id", "alert_schema", day(), "rule_id", "match_count", "distinct_count")


@query("d08_daily_flagged", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(sum(flagged) AS BIGINT) AS flagged_by_rule, count(*) FILTER (flagged > 0) AS flagged_by_rule_distinct FROM days GROUP BY ALL"))
def d08(spark: SparkSession, sf: str) -> DataFrame:
    flagged = D.daily_flagged(window_analysis(spark, sf).identity_days)
    return flagged.select("run_id", "alert_schema", day(), "flagged_by_rule", "flagged_by_rule_distinct")


@query("d09_daily_quality", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(flagged_by_llm AS BIGINT) AS flagged_by_llm, flagged_by_llm_distinct, needs_review, assessed_good, unassessed, phase2_gaps FROM quality_days", "weekly"))
def d09(spark: SparkSession, sf: str) -> DataFrame:
    a = weekly_analysis(spark, sf)
    quality = D.daily_quality(a.identity_days, states_of(a.identities, stored(spark, sf).facts.outcomes))
    return quality.select("run_id", "alert_schema", day(), "flagged_by_llm", "flagged_by_llm_distinct", "needs_review", "assessed_good", "unassessed", "phase2_gaps")


@query("d10_daily_visibility", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(sum(suppressed) AS BIGINT) AS suppressed, CAST(sum(unseen) AS BIGINT) AS unseen FROM days GROUP BY ALL"))
def d10(spark: SparkSession, sf: str) -> DataFrame:
    seen = D.daily_visibility(window_analysis(spark, sf).identity_days)
    return seen.select("run_id", "alert_schema", day(), "suppressed", c("unseen_seen").alias("unseen"))


@query("d11_first_bucket_allocation", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(suppression_unmeasured AS BIGINT) AS suppression_unmeasured, CAST(unseen_unmeasured AS BIGINT) AS unseen_unmeasured FROM metrics", "weekly"))
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).store.daily_metrics.select("run_id", "alert_schema", day(), "suppression_unmeasured", "unseen_unmeasured")


@query("d12_nullable_sum", sql("SELECT run_id, alert_schema, CAST(sum(unseen) AS BIGINT) AS unseen FROM metrics GROUP BY ALL", "weekly"))
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return D.weekly_rollup(stored(spark, sf).store.daily_metrics).select("run_id", "alert_schema", "unseen")


@query("d13_rule_breakdown", sql("SELECT run_id, alert_schema, rule_id, CAST(sum(match_count) AS BIGINT) AS matching_rows, sum(distinct_count) / 7.0::DOUBLE AS distinct_per_day FROM rule_days GROUP BY ALL", "weekly"))
def d13(spark: SparkSession, sf: str) -> DataFrame:
    return D.rule_breakdown(stored(spark, sf).store.daily_rule_counts)


# ------------------------------------------------------------------ firing episodes


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    return window_analysis(spark, sf).scoped


@query("e01_is_clear", sql("SELECT run_id, seq, is_clear FROM judged"))
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return _scoped(spark, sf).select("run_id", "seq", E.is_clear().alias("is_clear"))


@query("e02_instants", sql(f"SELECT {ID_SQL}, us, count(*) FILTER (NOT is_clear) AS fires, count(*) FILTER (is_clear) AS clears FROM ordered GROUP BY ALL"))
def e02(spark: SparkSession, sf: str) -> DataFrame:
    return E.instants(_scoped(spark, sf)).select(*ID, "us", "fires", "clears")


def _fact(name: str, columns: list[str], text: str, kind: str = "window") -> None:
    @query(name, sql(f"SELECT {ID_SQL}, {text} FROM firing", kind))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a = window_analysis(spark, sf, None if kind == "window" else FAN)
        return a.firing.select(*ID, *columns)


_fact("e03_largest_episode", ["clear_count", "max_episode_firing_rows"], "clear_count, max_episode_firing_rows")


@query("e04_cycles", sql(f"SELECT {ID_SQL}, us FROM ordered WHERE is_cycle"))
def e04(spark: SparkSession, sf: str) -> DataFrame:
    scanned = E.scan_slices(E.instants(_scoped(spark, sf)))
    stitched = E.stitch(E.summarize_slices(scanned), tuple(ID))
    return E.cycle_instants(scanned.where(c("cycle")), stitched)


_fact("e05_rolling_cycles", ["max_clear_cycles_24h"], "max_clear_cycles_24h")
_fact("e06_open_episode", ["open_us", "open_span_us"], "open_us, open_span_us")
_fact("e07_span_and_rate", ["row_count", "span_us", "events_per_24h"], "CAST(row_count AS BIGINT) AS row_count, span_us, events_per_24h", "wide")
_fact("e08_fire_pattern", ["fire_pattern"], "fire_pattern")
_fact("e08_fire_pattern_wide", ["fire_pattern", "max_clear_cycles_24h", "open_us"], "fire_pattern, max_clear_cycles_24h, open_us", "wide")


@query("e09_pattern_on_every_row", sql(f"SELECT {ID_SQL}, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(r6 AS BIGINT) AS r6_rows FROM days WHERE r6 > 0"))
def e09(spark: SparkSession, sf: str) -> DataFrame:
    return window_analysis(spark, sf).identity_days.where(c("R6") > 0).select(*ID, day(), c("R6").alias("r6_rows"))


@query("e09_pattern_evidence", sql(f"""SELECT {ID_SQL}, fire_pattern AS pattern, CAST(row_count AS BIGINT) AS rows, CAST(row_count AS BIGINT) AS matched_rows, CAST(clear_count AS BIGINT) AS clear_count, CAST(max_clear_cycles_24h AS BIGINT) AS max_clear_cycles_24h,
CAST(max_episode_firing_rows AS BIGINT) AS max_episode_firing_rows, round_even(CAST(open_span_us AS DOUBLE) / 3600000000, 2) AS open_hours, round_even(CAST(span_us AS DOUBLE) / 3600000000, 2) AS span_hours, round_even(events_per_24h, 2) AS events_per_24h FROM ids WHERE fire_pattern IS NOT NULL""", "weekly"))
def e09b(spark: SparkSession, sf: str) -> DataFrame:
    """The eight fields of the stored R6 evidence."""
    said = (
        "pattern string, rows long, clear_count long, max_clear_cycles_24h long, max_episode_firing_rows long, "
        "open_hours double, span_hours double, events_per_24h double"
    )
    entry = f"array<struct<rule_id: string, matched_rows: long, sample_evidence: struct<{said.replace(' long', ': long').replace(' string', ': string').replace(' double', ': double')}>>>"
    listed = stored(spark, sf).store.alert_findings.select(*ID, F.inline(F.from_json("findings_evidence", entry)))
    return listed.where("rule_id = 'R6'").select(*ID, "sample_evidence.*", "matched_rows")


@query("e09_suppression_evidence", sql("""SELECT run_id, alert_schema, application, key_field, CAST(r5 AS BIGINT) AS matched_rows,
CASE WHEN team_id = 'team-b' THEN 'B1' WHEN alert_schema = 'v1' THEN 'A1,A2' ELSE 'A3' END AS panels, 'excluded by every supplied panel for this schema' AS reason FROM ids WHERE r5 > 0""", "weekly"))
def e09c(spark: SparkSession, sf: str) -> DataFrame:
    entry = "array<struct<rule_id: string, matched_rows: long, sample_evidence: struct<panels: array<string>, reason: string>>>"
    listed = stored(spark, sf).store.alert_findings.select(*ID, F.inline(F.from_json("findings_evidence", entry)))
    kept = listed.where("rule_id = 'R5'")
    return kept.select(*ID, "matched_rows", F.array_join("sample_evidence.panels", ",").alias("panels"), "sample_evidence.reason")


PATTERN_SQL = "SELECT run_id, alert_schema, fire_pattern, count(*) AS alerts, CAST(sum(row_count) AS BIGINT) AS events FROM palerts WHERE fire_pattern IS NOT NULL GROUP BY ALL"


@query("e10_dominant_pattern", sql("SELECT run_id, fire_pattern FROM (SELECT run_id, fire_pattern, row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, sum(row_count) DESC, CASE fire_pattern WHEN 'flapping' THEN 0 WHEN 'spamming' THEN 1 ELSE 2 END) AS r FROM ranked WHERE fire_pattern IS NOT NULL GROUP BY run_id, fire_pattern) x WHERE r = 1", "weekly"))
def e10(spark: SparkSession, sf: str) -> DataFrame:
    return N.dominant_pattern(N.pattern_counts(stored(spark, sf).store.alert_findings))


@query("e11_pattern_counts", sql(PATTERN_SQL.replace("palerts", "ranked"), "weekly"))
def e11(spark: SparkSession, sf: str) -> DataFrame:
    return N.pattern_counts(stored(spark, sf).store.alert_findings)


# ------------------------------------------------------------------ panels

# leaves derived from the supplier table, variables from the nation table
FIELDS = ("node_name", "Application", "operator", "severity", "message", "teapot", "key_field", "status")
LEAF_FIELD = "CASE s_suppkey % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FIELDS)) + " END"
VAR_TYPES = ("constant", "custom", "query", "interval")


def _leaf_registry(spark: SparkSession, sf: str) -> Registry:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    key = c("s_suppkey")
    array = lambda values: F.array(*[F.lit(v) for v in values])
    kind = F.element_at(array(("comparison", "in", "like", "call", "comparison", "is_null")), (key % 6 + 1).cast("int"))
    op = (
        F.when(key % 6 == 0, "=").when(key % 6 == 4, "<>").when(key % 6 == 1, "IN").when(key % 6 == 2, "LIKE")
        .when(key % 6 == 3, F.when(key % 4 == 1, "__timeFilter").otherwise("lower")).otherwise("IS NULL")
    )
    literal = F.struct(F.lit("literal").alias("kind"), F.concat(F.lit("v"), key.cast("string")).alias("value"))
    variable = F.struct(F.lit("variable").alias("kind"), F.concat(F.lit("n"), c("s_nationkey").cast("string")).alias("value"))
    missing = F.struct(F.lit("variable").alias("kind"), F.lit("nowhere").alias("value"))
    other = F.struct(F.lit("field").alias("kind"), F.lit("node_name").alias("value"))
    operands = (
        F.when(key % 5 == 0, F.array(literal)).when(key % 5 == 1, F.array(literal, variable))
        .when(key % 5 == 2, F.array(variable)).when(key % 5 == 3, F.array(missing, literal))
        .otherwise(F.array(other))
    )
    team = F.concat(F.lit("team-"), (c("s_nationkey") % 5).cast("string")).alias("team_id")
    panel = F.concat(F.lit("panel-"), (c("s_nationkey") % 10).cast("string")).alias("panel_id")
    predicates = s.select(
        team, panel, F.lit("v1").alias("alert_schema"), key.cast("int").alias("leaf_no"), kind.alias("kind"),
        F.element_at(array(FIELDS), (key % 8 + 1).cast("int")).alias("field"), op.alias("op"),
        (key % 3 == 0).alias("negated"), operands.alias("operands"), (key % 7 == 0).alias("nested"),
        F.lit(True).alias("macro"),
    )
    panels = predicates.select("team_id", "panel_id", "alert_schema").distinct().select(
        "team_id", F.lit(0).alias("panel_no"), "panel_id", "alert_schema", F.lit("").alias("sql"),
        F.when(c("panel_id") == "panel-7", "unparseable").otherwise("parsed").alias("parse_state"),
        F.when(c("panel_id") == "panel-7", "expected FROM").alias("parse_error"),
    )
    nk = c("n_nationkey")
    vtype = F.element_at(array(VAR_TYPES), (nk % 4 + 1).cast("int"))
    variables = nation.select(
        F.concat(F.lit("team-"), (nk % 5).cast("string")).alias("team_id"),
        F.concat(F.lit("panel-"), (nk % 10).cast("string")).alias("panel_id"), F.lit("v1").alias("alert_schema"),
        F.concat(F.lit("n"), nk.cast("string")).alias("name"), vtype.alias("type"),
        F.when(nk % 8 != 0, c("n_name")).alias("value"),
        F.when(nk % 3 != 0, F.array("n_name", F.lit("x"))).alias("values"), (nk % 2 == 1).alias("all_selected"),
    )
    none = spark.createDataFrame([], "team_id string, alert_schema string, operator string")
    return Registry(panels.select("team_id").distinct(), none, panels, variables, predicates)


LEAF_SQL = f"""leaf AS MATERIALIZED (SELECT *, CASE WHEN s_suppkey % 6 = 0 THEN '=' WHEN s_suppkey % 6 = 4 THEN '<>' WHEN s_suppkey % 6 = 1 THEN 'IN'
    WHEN s_suppkey % 6 = 2 THEN 'LIKE' WHEN s_suppkey % 6 = 3 THEN CASE WHEN s_suppkey % 4 = 1 THEN '__timeFilter' ELSE 'lower' END ELSE 'IS NULL' END AS op,
  CASE s_suppkey % 6 WHEN 1 THEN 'in' WHEN 2 THEN 'like' WHEN 3 THEN 'call' WHEN 5 THEN 'is_null' ELSE 'comparison' END AS kind,
  {LEAF_FIELD} AS field, s_suppkey % 3 = 0 AS negated, s_suppkey % 7 = 0 AS nested, s_suppkey % 5 AS shape,
  'variable "n' || s_nationkey || '"' AS vname,
  s_nationkey % 4 AS vt, s_nationkey % 8 <> 0 AS has_value, s_nationkey % 3 <> 0 AS has_values, s_nationkey % 2 = 1 AS all_selected
  FROM supplier),
resolved AS MATERIALIZED (SELECT *, CASE WHEN vt = 2 THEN vname || ' is a query variable and is never executed'
    WHEN vt IN (0, 3) AND NOT has_value THEN vname || ' is ' || CASE vt WHEN 0 THEN 'constant' ELSE 'interval' END || ' but supplies no value'
    WHEN vt = 1 AND NOT has_values THEN vname || ' is custom but supplies no values' END AS vreason FROM leaf),
meant AS MATERIALIZED (SELECT *, CASE shape WHEN 0 THEN NULL WHEN 3 THEN 'no frozen definition supplied for variable "nowhere"'
    WHEN 4 THEN 'comparison against another column is not interpreted' ELSE vreason END AS reason,
  shape IN (1, 2) AND vt = 1 AND all_selected AND has_values AS selects_all,
  CASE WHEN kind = 'comparison' AND op = '=' THEN '=' WHEN kind = 'in' AND NOT negated THEN 'IN' WHEN kind = 'like' AND NOT negated THEN 'LIKE' END AS positive,
  CASE WHEN kind = 'comparison' AND op = '<>' THEN '<>' WHEN kind = 'in' AND negated THEN 'NOT IN' WHEN kind = 'like' AND negated THEN 'NOT LIKE' END AS negation,
  lower(field) IN ('operator', 'application', 'node_name', 'object', 'component') AS narrowing FROM resolved)
"""
OUTCOME_SQL = f"""WITH {LEAF_SQL} SELECT CAST(s_suppkey AS INT) AS leaf_no, field, CASE
  WHEN kind = 'call' THEN 'ignored' WHEN narrowing AND positive IS NOT NULL AND nested THEN 'identity_unmeasured'
  WHEN narrowing AND positive IS NOT NULL AND selects_all THEN 'ignored'
  WHEN narrowing AND positive IS NOT NULL AND reason IS NOT NULL THEN 'identity_unmeasured'
  WHEN narrowing AND positive IS NOT NULL THEN 'identity'
  WHEN lower(field) IN ('severity', 'environment', 'status', 'provider', 'operator') THEN 'ignored'
  WHEN lower(field) = 'teapot' THEN 'ignored' WHEN negation IS NULL THEN 'ignored'
  WHEN nested THEN 'unmeasured' WHEN reason IS NOT NULL THEN 'unmeasured' ELSE 'suppression' END AS outcome,
  CASE WHEN kind = 'call' AND op = '__timeFilter' THEN 'mechanical macro $__timeFilter' WHEN kind = 'call' THEN 'function call lower() is not interpreted'
  WHEN narrowing AND positive IS NOT NULL AND nested THEN 'identity leaf is nested inside OR/NOT and cannot be evaluated safely'
  WHEN narrowing AND positive IS NOT NULL AND selects_all THEN 'multi-value variable with all selected'
  WHEN narrowing AND positive IS NOT NULL AND reason IS NOT NULL THEN reason
  WHEN narrowing AND positive IS NOT NULL THEN NULL
  WHEN lower(field) IN ('severity', 'environment', 'status', 'provider', 'operator') THEN 'classification dimension'
  WHEN lower(field) = 'teapot' THEN 'unknown field, ignored and logged' WHEN negation IS NULL THEN 'instance field, but not a negation'
  WHEN nested THEN 'suppression leaf is nested inside OR/NOT and cannot be evaluated safely' ELSE reason END AS reason FROM meant"""


@query("v01_field_classes", f"SELECT s_suppkey, CASE WHEN lower(f) IN ('node_name', 'message', 'object', 'component', 'key_field', 'alert_rule_url', 'application') THEN 'instance' WHEN lower(f) IN ('severity', 'environment', 'status', 'provider', 'operator') THEN 'classification' ELSE 'unknown' END AS class, lower(f) IN ('operator', 'application', 'node_name', 'object', 'component') AS narrows, CASE WHEN lower(f) IN ('node_name', 'message', 'key_field', 'application') THEN lower(f) END AS attribute FROM (SELECT s_suppkey, {LEAF_FIELD} AS f FROM supplier) t")
def v01(spark: SparkSession, sf: str) -> DataFrame:
    leaves = _leaf_registry(spark, sf).panel_predicates
    return leaves.select(
        c("leaf_no").cast("long").alias("s_suppkey"), V.field_class(c("field")).alias("class"),
        V.is_identity_field(c("field")).alias("narrows"), V.record_attribute(c("field")).alias("attribute"),
    )


@query("v02_variable_resolution", f"""WITH {LEAF_SQL}, shown AS (
  SELECT s_suppkey, 0 AS pos, 'v' || s_suppkey AS vals, NULL AS reason FROM meant WHERE shape IN (0, 1)
  UNION ALL SELECT s_suppkey, CASE shape WHEN 1 THEN 1 ELSE 0 END, CASE WHEN vreason IS NULL THEN n_name || CASE WHEN vt = 1 THEN '|x' ELSE '' END END, vreason
    FROM meant JOIN nation ON n_nationkey = s_nationkey WHERE shape IN (1, 2)
  UNION ALL SELECT s_suppkey, 0, NULL, reason FROM meant WHERE shape IN (3, 4)
  UNION ALL SELECT s_suppkey, 1, 'v' || s_suppkey, NULL FROM meant WHERE shape = 3)
SELECT CAST(s_suppkey AS INT) AS leaf_no, CAST(pos AS INT) AS pos, vals, reason FROM shown""")
def v02(spark: SparkSession, sf: str) -> DataFrame:
    resolved = V.resolve_operands(_leaf_registry(spark, sf))
    shown = F.when(c("reason").isNull(), F.array_join("resolved_values", "|"))
    return resolved.select("leaf_no", "pos", shown.alias("vals"), "reason")


@query("v03_leaf_meaning", OUTCOME_SQL)
def v03(spark: SparkSession, sf: str) -> DataFrame:
    return V.interpret_leaves(_leaf_registry(spark, sf)).select("leaf_no", "field", "outcome", "reason")


@query("v04_leaf_excludes_row", sql("SELECT run_id, seq, list_aggregate(list_filter(CASE WHEN team_id = 'team-a' AND alert_schema = 'v1' THEN [CASE WHEN hit_node THEN '0' END, CASE WHEN hit_like THEN '1' END] WHEN team_id = 'team-a' THEN [CASE WHEN hit_app THEN '0' END] ELSE [CASE WHEN hit_node THEN '1' END] END, lambda x: x IS NOT NULL), 'string_agg', ',') AS hits FROM judged WHERE (team_id = 'team-a' AND alert_schema = 'v2' AND hit_app) OR (alert_schema = 'v1' AND (hit_node OR (team_id = 'team-a' AND hit_like)))"))
def v04(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    marked = V.mark_visibility(a.scoped, a.panel_plans)
    return marked.where(F.size("hit_leaves") > 0).select("run_id", "seq", F.array_join("hit_leaves", ",").alias("hits"))


@query("v05_leaf_hides_row", sql("SELECT run_id, seq FROM judged WHERE hides_b1"))
def v05(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    marked = V.mark_visibility(a.scoped, a.panel_plans)
    return marked.where("hidden").select("run_id", "seq")


PATTERNS = ("%CLICK%", "%c_i%", "click", "view%", "%or", "p_rchase", "%", "100%_", "err.r")


@query("v06_like", "SELECT event_id, event_type LIKE CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PATTERNS)) + " END AS hit FROM events")
def v06(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (c("event_id") % 9 + 1).cast("int"))
    return e.select("event_id", V.like_matches(c("event_type"), pattern).alias("hit"))


@query("v07_blast_radius", sql("""SELECT r.run_id, x.panel_id, CAST(x.leaf_no AS INT) AS leaf_no, CAST(x.m AS BIGINT) AS matched_rows, CAST(x.t AS BIGINT) AS total_rows, CASE WHEN 2 * x.m > x.t THEN 'unmeasured' ELSE 'suppression' END AS outcome
FROM runs r JOIN (SELECT run_id, 'A1' AS panel_id, 0 AS leaf_no, node_n AS m, total AS t, alert_schema AS s, 'team-a' AS team FROM guard
  UNION ALL SELECT run_id, 'A2', 0, like_n, total, alert_schema, 'team-a' FROM guard
  UNION ALL SELECT run_id, 'A3', 0, app_n, total, alert_schema, 'team-a2' FROM guard
  UNION ALL SELECT run_id, 'B1', 1, node_n, total, alert_schema, 'team-b' FROM guard) x ON x.run_id = r.run_id AND substr(x.team, 1, 6) = r.team_id AND x.s = CASE x.team WHEN 'team-a2' THEN 'v2' ELSE 'v1' END"""))
def v07(spark: SparkSession, sf: str) -> DataFrame:
    guarded = window_analysis(spark, sf).guarded.where(c("matched_rows").isNotNull())
    return guarded.select("run_id", "panel_id", "leaf_no", *n("matched_rows", "total_rows"), "outcome")


@query("v08_unanimous_suppression", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, count(*) AS suppressed FROM seen WHERE suppressed GROUP BY ALL"))
def v08(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    resolved = V.resolve_visibility(a.signatures, a.active)
    return resolved.where("suppressed").groupBy("run_id", "alert_schema", "snapshot_date").agg(
        F.sum("n").alias("suppressed")
    ).select("run_id", "alert_schema", day(), "suppressed")


@query("v09_unseen", sql(f"SELECT {ID_SQL}, count(*) AS unseen FROM seen WHERE hides_b1 AND NOT suppressed GROUP BY ALL"))
def v09(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    resolved = V.resolve_visibility(a.signatures, a.active)
    return resolved.where("unseen").groupBy(*ID).agg(F.sum("n").alias("unseen"))


@query("v10_unmeasured_counts", sql("SELECT run_id, alert_schema, CAST(u AS BIGINT) AS suppression_unmeasured, CAST(iu AS BIGINT) AS unseen_unmeasured FROM unmeasured WHERE u IS NOT NULL"))
def v10(spark: SparkSession, sf: str) -> DataFrame:
    return window_analysis(spark, sf).unmeasured.select("run_id", "alert_schema", *n("suppression_unmeasured", "unseen_unmeasured"))


@query("v10_unmeasured_notes", sql("SELECT r.run_id, 'A3' AS panel_id, 'application - blast radius ' || app_n || '/' || total || ' exceeds 50% of owned rows; routed to human review' AS note FROM runs r JOIN guard g ON g.run_id = r.run_id AND alert_schema = 'v2' AND 2 * app_n > total WHERE team_id = 'team-a' UNION ALL SELECT run_id, 'B1', 'node_name - identity leaf is nested inside OR/NOT and cannot be evaluated safely' FROM runs WHERE team_id = 'team-b'"))
def v10b(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    return V.visibility_notes(a.reg, a.guarded, a.runs).select("run_id", "panel_id", "note")


@query("v11_suppression_findings", sql(f"SELECT {ID_SQL}, CAST(r5 AS BIGINT) AS matched_rows, CASE WHEN team_id = 'team-b' THEN 'B1' WHEN alert_schema = 'v1' THEN 'A1,A2' ELSE 'A3' END AS panels FROM rolled WHERE r5 > 0", "wide"))
def v11(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf, FAN)
    late = I.late_evidence(a.identities, a.active).where(c("rule_id") == "R5")
    panels = F.array_join(F.from_json(F.get_json_object("evidence", "$.panels"), "array<string>"), ",")
    return late.select(*ID, "matched_rows", panels.alias("panels"))


@query("v12_panel_participation", sql("""SELECT r.run_id, p AS panel_id, CAST(CASE p WHEN 'A3' THEN 1 - u ELSE 1 END AS BIGINT) AS suppression_leaves, CAST(CASE p WHEN 'A3' THEN u ELSE 0 END AS BIGINT) AS unmeasured_leaves, 'parsed' AS safety_state
FROM runs r CROSS JOIN (VALUES ('A1', 'team-a', 'v1'), ('A2', 'team-a', 'v1'), ('A3', 'team-a', 'v2'), ('B1', 'team-b', 'v1')) x(p, t, s) JOIN unmeasured m ON m.run_id = r.run_id AND m.alert_schema = s WHERE x.t = r.team_id"""))
def v12(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    rows = V.panel_participation(a.reg, a.guarded, a.runs)
    return rows.select("run_id", "panel_id", *n("suppression_leaves", "unmeasured_leaves"), "safety_state")


@query("v13_signatures", sql(f"SELECT {ID_SQL}, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(r1 + 2 * r2 + 4 * r3 + 8 * r4 + 16 * r7 + 32 * r8 + 64 * r9 + 128 * r10 AS INT) AS rule_mask, hides_b1 AS hidden, count(*) AS n FROM judged GROUP BY ALL"))
def v13(spark: SparkSession, sf: str) -> DataFrame:
    sigs = window_analysis(spark, sf).signatures
    return sigs.groupBy(*ID, "snapshot_date", "rule_mask", "hidden").agg(F.sum("n").alias("n")).select(
        *ID, day(), "rule_mask", "hidden", "n"
    )

