"""Published weeks: the reader's views and queries over the fact tables.

Every function covers all teams and weeks at once and keeps the run or team in its keys; a
caller narrows with an ordinary filter, which Catalyst pushes down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.text import id_list, ids_contain, rule_number, strip
from sirenlens.operators.ordered import with_running

c = F.col
ALERT_KEY = ["alert_schema", "application", "key_field"]


@dataclass(frozen=True)
class Store:
    """The stored tables the published views read."""

    runs: DataFrame
    daily_metrics: DataFrame
    daily_rule_counts: DataFrame
    alert_findings: DataFrame
    publications: DataFrame
    decisions: DataFrame
    log: DataFrame


def json_fragment(document: Column, path: str) -> Column:
    """An array or object as text; NULL for a scalar, null or absent value."""
    text = F.get_json_object(document, path)
    return F.when(F.substring(strip(text), 1, 1).isin("[", "{"), text)


def json_scalar(document: Column, path: str) -> Column:
    """A scalar as text; NULL for null, absent or a container."""
    text = F.get_json_object(document, path)
    return F.when(~F.substring(strip(text), 1, 1).isin("[", "{"), text)


def measurement_basis(snapshot: Column) -> Column:
    """What of a stored registry entry changes how alerts are measured, hashed."""
    dash = F.lit("-")
    parts = F.concat(
        F.coalesce(json_fragment(snapshot, "$.v1_operators"), dash),
        F.lit("|"),
        F.coalesce(json_fragment(snapshot, "$.panels"), dash),
        F.lit("|"),
        F.coalesce(F.concat(F.lit('"'), json_scalar(snapshot, "$.v2_operator")), dash),
    )
    return F.sha2(F.when(F.get_json_object(snapshot, "$").isNotNull(), parts).otherwise("-|-|-"), 256)


def current_publications(publications: DataFrame) -> DataFrame:
    return publications.where(c("withdrawn_at").isNull())


def reviews(s: Store) -> DataFrame:
    """Current published weeks of completed runs, with whether the measurement basis moved since
    the team's previous published week."""
    joined = (
        current_publications(s.publications)
        .select("publication_id", "run_id", "published_at", "review_note")
        .join(s.runs.where(c("status") == "completed"), "run_id")
        .withColumn("basis", measurement_basis(c("registry_entry_snapshot")))
    )
    order = Window.partitionBy("team_id").orderBy("window_end", "publication_id")
    before = F.lag("ruleset_version").over(order)
    moved = (before != c("ruleset_version")) | (F.lag("basis").over(order) != c("basis"))
    effort = F.get_json_object("registry_entry_snapshot", "$.planning.v1_rule_effort_days")
    return joined.select(
        "publication_id",
        "team_id",
        "team_display_name",
        "run_id",
        "window_start",
        "window_end",
        "published_at",
        "review_note",
        "phase_derived",
        "phase2_readiness_pct",
        F.coalesce(moved, F.lit(False)).alias("basis_changed"),
        effort.try_cast("decimal(6,2)").alias("v1_rule_effort_days"),
    )


def attention_rank() -> Column:
    state = c("quality_state")
    return (
        F.when(state == "rule_flagged", 0)
        .when(state == "llm_flagged", 1)
        .when(state == "needs_review", 2)
        .when(c("readiness_rule_ids") != "", 3)
        .otherwise(4)
    )


def schema_totals(s: Store, weeks: DataFrame) -> DataFrame:
    """Per published week and schema: events, alerts and states; ``unseen`` stays NULL where
    nothing measured it."""
    daily = s.daily_metrics.groupBy("run_id", "alert_schema").agg(
        F.sum("alerts").alias("events"),
        F.sum("flagged_by_rule").alias("flagged_rows"),
        F.sum("suppressed").alias("suppressed"),
        F.sum("unseen").alias("unseen"),
    )
    states = {q: F.count_if(c("quality_state") == q).alias(q) for q in K.QUALITY_STATES}
    found = s.alert_findings.groupBy("run_id", "alert_schema").agg(
        F.count("*").alias("distinct_alerts"),
        *states.values(),
        F.count_if(c("readiness_rule_ids") != "").alias("readiness_gaps"),
        F.count_if(attention_rank() < 4).alias("needs_attention"),
        F.sum(c("unseen").cast("long")).alias("unseen_alerts"),
        F.count_if(c("fire_pattern").isNotNull()).alias("r6_alerts"),
    )
    schemas = F.explode(F.array(*[F.lit(x) for x in K.SCHEMAS])).alias("alert_schema")
    grid = weeks.select("run_id", schemas)
    keys = ["run_id", "alert_schema"]
    joined = grid.join(daily, keys, "left").join(found, keys, "left")
    zeroed = [n for n in (*daily.columns, *found.columns)
              if n not in (*keys, "unseen", "unseen_alerts")]
    return joined.fillna(0, subset=zeroed)


def all_rule_ids() -> Column:
    return F.concat(id_list(c("core_rule_ids")), id_list(c("readiness_rule_ids")))


def rule_totals(s: Store, weeks: DataFrame) -> DataFrame:
    """Per published week, schema and rule: matching rows and alerts of the whole week."""
    keys = ["run_id", "alert_schema", "rule_id"]
    events = s.daily_rule_counts.groupBy(*keys).agg(F.sum("match_count").alias("events"))
    carriers = (
        s.alert_findings.select("run_id", "alert_schema", F.explode(all_rule_ids()).alias("rule_id"))
        .groupBy(*keys)
        .agg(F.count("*").alias("alerts"))
    )
    return (
        events.join(weeks.select("run_id"), "run_id", "left_semi")
        .join(carriers, keys, "left")
        .fillna(0, subset=["alerts"])
    )


def published_alerts(s: Store, weeks: DataFrame) -> DataFrame:
    """Alerts of published weeks with the fields a reviewer needs from the stored document."""
    kept = [n for n in s.alert_findings.columns
            if n not in ("representative_doc", "representative_hash", "team_id")]
    document = c("representative_doc")
    picked = {
        "impact": "$.impact",
        "runbook_url": "$.runbook_url",
        "alert_status": "$.status",
        "time_created": "$.time_created",
    }
    return s.alert_findings.join(weeks.select("run_id"), "run_id", "left_semi").select(
        *kept,
        *[json_scalar(document, path).alias(name) for name, path in picked.items()],
        attention_rank().alias("attention_rank"),
    )


def published_decisions(s: Store, weeks: DataFrame) -> DataFrame:
    return s.decisions.join(weeks.select("run_id"), "run_id", "left_semi")


def published_days(s: Store, weeks: DataFrame) -> DataFrame:
    return s.daily_metrics.join(weeks.select("run_id"), "run_id", "left_semi").select(
        "run_id",
        "alert_schema",
        "snapshot_date",
        "covered_hours",
        "distinct_alerts",
        "flagged_by_rule_distinct",
    )


def team_directory(weeks: DataFrame) -> DataFrame:
    """Each team's latest published week and how many it has."""
    team = Window.partitionBy("team_id")
    newest = team.orderBy(c("window_end").desc(), c("run_id").desc())
    return (
        weeks.withColumn("recency", F.row_number().over(newest))
        .withColumn("weeks", F.count("*").over(team))
        .where(c("recency") == 1)
        .drop("recency")
    )


def team_weeks(weeks: DataFrame, totals: DataFrame) -> DataFrame:
    """Every published week with both schemas' totals side by side."""
    columns = [n for n in totals.columns if n not in ("run_id", "alert_schema")]
    wide = (
        totals.groupBy("run_id")
        .pivot("alert_schema", list(K.SCHEMAS))
        .agg(*[F.first(n).alias(n) for n in columns])
    )
    return weeks.join(wide, "run_id")


def filter_worklist(
    alerts: DataFrame,
    schema: str | None = None,
    state: str | None = None,
    rule: str | None = None,
    attention_only: bool = False,
) -> DataFrame:
    """The work list narrowed by any of the four filters; an unknown value narrows nothing."""
    if schema in K.SCHEMAS:
        alerts = alerts.where(c("alert_schema") == schema)
    if state in K.QUALITY_STATES:
        alerts = alerts.where(c("quality_state") == state)
    if rule in K.ALL_RULES:
        has = ids_contain(c("core_rule_ids"), rule) | ids_contain(c("readiness_rule_ids"), rule)
        alerts = alerts.where(has)
    if attention_only:
        alerts = alerts.where(attention_rank() < 4)
    return alerts


WORKLIST_ORDER = [attention_rank, lambda: -c("row_count"), lambda: c("alert_schema"),
                  lambda: c("application"), lambda: c("key_field")]


def worklist_pages(alerts: DataFrame, page_size: int) -> DataFrame:
    """Every alert of every run with its position and page, without sorting a run in one task."""
    ranked = with_running(alerts, ["run_id"], [o() for o in WORKLIST_ORDER])
    return ranked.withColumn("page", F.ceil(c("rank") / F.lit(page_size)).cast("long")).withColumn(
        "pages", F.ceil(c("group_size") / F.lit(page_size)).cast("long")
    )


#: Alerts of a run up to which a page is found among the first ones, without ranking all.
EARLY = 10_000


def worklist_page(alerts: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of every run; a page past the end is the last page.

    For an early page every task keeps no more than the alerts up to its end, per run, before anything
    is shuffled, and nothing is written. Only a page that the caller asks for beyond ``EARLY`` alerts
    is taken from the written rank of all.
    """
    page = max(page, 1)
    if page * page_size > EARLY:
        paged = worklist_pages(alerts, page_size)
        return paged.where(c("page") == F.least(F.lit(page), c("pages"))).drop("group_size")
    order = Window.partitionBy("run_id").orderBy(*[o() for o in WORKLIST_ORDER])
    first = alerts.withColumn("rank", F.row_number().over(order)).where(c("rank") <= page * page_size)
    size = F.lit(page_size)
    pages = alerts.groupBy("run_id").agg(F.ceil(F.count("*") / size).cast("long").alias("pages"))
    placed = first.withColumn("page", F.ceil(c("rank") / size).cast("long")).join(pages, "run_id")
    # a run of fewer pages has all its alerts among the first
    return placed.where(c("page") == F.least(F.lit(page), c("pages"))).select(*alerts.columns, "rank", "page", "pages")


def worklist_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(attention_rank() < 4).alias("attention")
    )


def decision_history(decisions: DataFrame) -> DataFrame:
    """Every decision with its position in its identity-finding's history, oldest first."""
    order = Window.partitionBy(*ALERT_KEY, "finding_id").orderBy("decided_at", "decision_id")
    return decisions.withColumn("position", F.row_number().over(order))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The current decision per identity and finding, pre-reduced before the shuffle."""
    newest = F.struct("decided_at", "decision_id")
    best = decisions.groupBy(*ALERT_KEY, "finding_id").agg(
        F.max_by(F.struct("state", "note", "decided_at", "decided_by", "decision_id"), newest).alias("d")
    )
    return best.select(*ALERT_KEY, "finding_id", "d.*")


def team_overview(s: Store) -> DataFrame:
    """Per team: latest published week, weeks published, and the schedule's last outcome."""
    published = (
        current_publications(s.publications)
        .groupBy("team_id")
        .agg(F.max("window_end").alias("latest"), F.count("*").alias("weeks"))
    )
    last = s.log.groupBy("team_id").agg(
        F.max_by(F.struct("outcome", "window_end", "detail", "invoked_at"), "log_id").alias("l")
    ).select("team_id", c("l.outcome").alias("last_outcome"),
             c("l.window_end").alias("last_window_end"), c("l.invoked_at").alias("last_invoked_at"))
    return published.join(last, "team_id", "full_outer")


def team_runs(s: Store, limit: int = 60) -> DataFrame:
    """Every team's newest runs with their publication state and counts."""
    unassessed = s.alert_findings.where(c("quality_state") == "unassessed").groupBy("run_id").agg(
        F.count("*").alias("unassessed")
    )
    withdrawn = s.publications.where(c("withdrawn_at").isNotNull()).groupBy("run_id").agg(
        F.count("*").alias("withdrawn")
    )
    current = current_publications(s.publications).select(
        "run_id", "publication_id", "published_at", "published_by"
    )
    newest = Window.partitionBy("team_id").orderBy(
        c("window_end").desc(), c("completed_at").desc(), c("run_id").desc()
    )
    recent = s.runs.withColumn("position", F.row_number().over(newest)).where(
        c("position") <= limit
    )
    return (
        recent.join(current, "run_id", "left")
        .join(unassessed, "run_id", "left")
        .join(withdrawn, "run_id", "left")
        .fillna(0, subset=["unassessed", "withdrawn"])
    )


def team_log(log: DataFrame, limit: int = 30) -> DataFrame:
    newest = Window.partitionBy("team_id").orderBy(c("log_id").desc())
    return log.withColumn("position", F.row_number().over(newest)).where(c("position") <= limit)


def alerts_with_findings(findings: DataFrame, page: int, page_size: int = 50) -> DataFrame:
    """One page of every run's alerts that carry any finding, worst state first."""
    return worklist_page(findings.where(attention_rank() < 4), page, page_size)


def alert_detail(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts with the history of decisions on the exact identity (one row per decision)."""
    return alerts.join(decision_history(decisions).drop("run_id", "team_id"), ALERT_KEY, "left")


def rule_key() -> Column:
    """The unit of migration work of a v1 alert: its rule URL, else its application."""
    url = strip(F.coalesce(c("alert_rule_url"), F.lit("")))
    return F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(
        F.concat(F.lit("app:"), c("application"))
    )


def week_rules(findings: DataFrame, weeks: DataFrame) -> DataFrame:
    """Distinct v1 rule keys per published week, one row each."""
    return (
        findings.where(c("alert_schema") == "v1")
        .join(weeks.select("run_id", "team_id", "window_end").withColumnRenamed("team_id", "t"), "run_id")
        .select(c("t").alias("team_id"), "run_id", "window_end", rule_key().alias("rule_key"))
        .distinct()
    )


def history(weeks: DataFrame, last: int = 4) -> DataFrame:
    """For every published week: itself and the weeks before it that a pace may use."""
    order = Window.partitionBy("team_id").orderBy("window_end", "run_id")
    numbered = weeks.withColumn("n", F.row_number().over(order)).select(
        "team_id", "run_id", "window_end", "basis_changed", "n"
    )
    earlier = numbered.select(
        "team_id",
        c("run_id").alias("past_run_id"),
        c("window_end").alias("past_end"),
        c("basis_changed").alias("past_basis_changed"),
        c("n").alias("past_n"),
    )
    # rows of one team's weeks, joined on the exact offsets rather than all pairs
    steps = numbered.withColumn(
        "past_n", F.explode(F.sequence(F.greatest(c("n") - (last - 1), F.lit(1)), c("n")))
    )
    return steps.join(earlier, ["team_id", "past_n"]).withColumn("age", c("n") - c("past_n"))


def trend(weeks: DataFrame, totals: DataFrame) -> DataFrame:
    return weeks.select("team_id", "run_id", "window_end").join(totals, "run_id").select(
        "team_id", "window_end", "alert_schema", "distinct_alerts", "events"
    )


def complete_days(days: DataFrame) -> DataFrame:
    return days.where(c("covered_hours") >= 24)


def publication_states(s: Store) -> DataFrame:
    """Each run's publication state: published before withdrawn before never, newest first."""
    order = Window.partitionBy("run_id").orderBy(
        F.when(c("withdrawn_at").isNull(), 0).otherwise(1), c("publication_id").desc()
    )
    best = s.publications.withColumn("r", F.row_number().over(order)).where(c("r") == 1).select(
        "run_id", "publication_id", "withdrawn_at"
    )
    state = (
        F.when(c("publication_id").isNull(), "never")
        .when(c("withdrawn_at").isNull(), "published")
        .otherwise("withdrawn")
    )
    return s.runs.select("run_id", "team_id").join(best, "run_id", "left").withColumn("state", state)


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(c("quality_state").isin("rule_flagged", "llm_flagged", "needs_review"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest completed run of every team, by a total order."""
    order = F.struct("run_at", "completed_at", "run_id")
    done = runs.where(c("status") == "completed")
    best = done.groupBy("team_id").agg(F.max_by("run_id", order).alias("run_id"))
    return done.join(best, ["team_id", "run_id"])


def stored_rule_counts(counts: DataFrame) -> DataFrame:
    return counts.orderBy("run_id", "alert_schema", "snapshot_date", rule_number(c("rule_id")))


def register_views(s: Store) -> None:
    """The published views under fixed names, for SQL readers."""
    weeks = reviews(s)
    weeks.createOrReplaceTempView("portal_reviews")
    schema_totals(s, weeks).createOrReplaceTempView("portal_schema_totals")
    published_alerts(s, weeks).createOrReplaceTempView("portal_alerts")
    published_decisions(s, weeks).createOrReplaceTempView("portal_decisions")
    rule_totals(s, weeks).createOrReplaceTempView("portal_rule_totals")
    published_days(s, weeks).createOrReplaceTempView("portal_daily_metrics")


