"""Weekly planning, publication and human decisions, as tables.

Everything covers all teams at once; per-team order is a window over that team's few weeks.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.text import id_list
from sirenlens.operators.published import ALERT_KEY, current_publications

c = F.col


def week() -> Column:
    return F.expr("INTERVAL 7 DAYS")


def is_week_boundary(ts: Column) -> Column:
    """A Monday 00:00:00 UTC."""
    return ts == F.date_trunc("week", ts)


def latest_week_end(now: Column) -> Column:
    return F.date_trunc("week", now)


def latest_published(publications: DataFrame) -> DataFrame:
    return current_publications(publications).groupBy("team_id").agg(
        F.max("window_end").alias("latest")
    )


def plan_weeks(latest: DataFrame, now: datetime, retention_days: int = K.RETENTION_DAYS) -> DataFrame:
    """Per team (``team_id, latest``): every completed week after its latest published one, each
    ``due`` or ``expired``; a team off the Monday grid is ``blocked``; a team with nothing
    published is due the latest completed week only."""
    at = F.lit(now)
    last = latest_week_end(at)
    none = c("latest").isNull()
    aligned = none | is_week_boundary(c("latest"))
    first = F.when(none, last).otherwise(c("latest") + week())
    weeks = F.when(
        aligned & (first <= last), F.sequence(first, last, week())
    ).otherwise(F.array().cast("array<timestamp>"))
    planned = latest.withColumn("blocked", ~aligned).withColumn("window_end", F.explode_outer(weeks))
    start = c("window_end") - week()
    expired = ~none & (start < at - F.expr(f"INTERVAL {retention_days} DAYS"))
    return planned.where(c("blocked") | c("window_end").isNotNull()).withColumn(
        "plan", F.when(c("blocked"), "blocked").when(expired, "expired").otherwise("due")
    )


def next_due(latest: DataFrame, now: datetime) -> DataFrame:
    """The next week end the schedule will publish for each team."""
    due = (
        plan_weeks(latest, now)
        .where(c("plan") == "due")
        .groupBy("team_id")
        .agg(F.min("window_end").alias("due"))
    )
    base = F.coalesce("latest", F.lit(now)) + week()
    return latest.join(due, "team_id", "left").select(
        "team_id", "latest", F.coalesce("due", base).alias("next_due")
    )


def run_health(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Why a stored run should not be published without a person; NULL ``problems`` is healthy."""
    lost = findings.where(c("quality_state") == "unassessed").groupBy("run_id").agg(
        F.count("*").alias("unassessed")
    )
    joined = runs.join(lost, "run_id", "left").fillna(0, subset=["unassessed"])
    problems = F.concat_ws(
        "; ",
        F.when(c("status") != "completed", F.concat(F.lit("the run is "), c("status"))),
        F.when(~c("llm_assessed"), "the model did not assess this week"),
        F.when(
            c("unassessed") > 0,
            F.concat(
                c("unassessed").cast("string"), F.lit(" alert(s) were not assessed by the model")
            ),
        ),
    )
    return joined.select(
        "run_id", "team_id", "window_end", "unassessed", F.nullif(problems, F.lit("")).alias("problems")
    )


def week_outcomes(health: DataFrame, log: DataFrame, now: datetime) -> DataFrame:
    """published / held / stored / failed for every due week of every team, oldest first.

    ``health`` has ``team_id, window_end, run_id, failed, problems``. A week with problems is
    held until it has been held for three days; once a week fails or is held, later healthy
    weeks are stored behind it.
    """
    held = log.where(c("outcome") == "held").groupBy("team_id", "window_end").agg(
        F.min("invoked_at").alias("first_held")
    )
    joined = health.join(held, ["team_id", "window_end"], "left")
    overdue = F.coalesce(
        c("first_held") <= F.lit(now) - F.expr(f"INTERVAL {K.HOLD_DAYS} DAYS"), F.lit(False)
    )
    # a blocked queue never reopens within one invocation, so the first blocking week decides
    blocks = c("failed") | (c("problems").isNotNull() & ~overdue)
    order = Window.partitionBy("team_id").orderBy("window_end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.max(blocks).over(before), F.lit(False))
    marked = joined.withColumn("overdue", overdue).withColumn("blocked", blocked)
    outcome = (
        F.when(c("failed"), "failed")
        .when(c("problems").isNotNull() & (c("blocked") | ~c("overdue")), "held")
        .when(c("blocked"), "stored")
        .otherwise("published")
    )
    return marked.withColumn("outcome", outcome).withColumn(
        "forced", (c("outcome") == "published") & c("problems").isNotNull()
    )


def weekly_status(teams: DataFrame, publications: DataFrame, log: DataFrame, now: datetime) -> DataFrame:
    latest = teams.select("team_id").join(latest_published(publications), "team_id", "left")
    last = log.groupBy("team_id").agg(
        F.max_by(F.struct("outcome", "invoked_at"), "log_id").alias("l")
    ).select("team_id", c("l.outcome").alias("last_outcome"), c("l.invoked_at").alias("last_invoked_at"))
    return next_due(latest, now).join(last, "team_id", "left")


def check_publications(
    candidates: DataFrame, publications: DataFrame, allow_gap: bool = False, replace: bool = False
) -> DataFrame:
    """Why each candidate week (``run_id, team_id, window_start, window_end``) may not be
    published next to its team's current weeks; NULL ``refused`` means it may.

    Weeks that could overlap share a week-long time cell with the candidate, so they are found by
    an equi-join; the neighbours come from one ordered pass per team. No week is compared with
    every other.
    """
    cell_us = K.WINDOW_HOURS * K.HOUR_US
    keys = ["run_id", "team_id", "window_start", "window_end"]
    weeks = current_publications(publications).select(
        "team_id",
        c("run_id").alias("w_run"),
        c("window_start").alias("w_start"),
        c("window_end").alias("w_end"),
    )

    def cells(start: str, end: str) -> Column:
        first = F.floor(F.unix_micros(start) / cell_us)
        return F.explode(F.sequence(first, F.floor((F.unix_micros(end) - 1) / cell_us)))

    near = candidates.withColumn("cell", cells("window_start", "window_end")).join(
        weeks.withColumn("cell", cells("w_start", "w_end")), ["team_id", "cell"]
    )
    same = (c("w_start") == c("window_start")) & (c("w_end") == c("window_end"))
    crossing = (c("w_start") < c("window_end")) & (c("window_start") < c("w_end")) & ~same
    touched = near.groupBy(*keys).agg(F.max(same).alias("taken"), F.max(crossing).alias("overlaps"))
    again = candidates.join(
        weeks.select("team_id", c("w_run").alias("run_id")), ["team_id", "run_id"], "left_semi"
    ).select(*keys, F.lit(True).alias("again"))

    none = F.lit(None).cast("timestamp")
    asked = candidates.select(*keys)
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in asked.dtypes if name != "team_id"]
    marks = weeks.select("team_id", *blank, "w_start", "w_end")
    # a week sorts before a candidate at the same instant
    ends = asked.select("*", none.alias("w_start"), none.alias("w_end")).unionByName(marks)
    back = Window.partitionBy("team_id").orderBy(
        F.coalesce("w_end", "window_start"), c("w_end").isNull()
    ).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("team_id").orderBy(
        F.coalesce("w_start", "window_end").desc(), c("w_start").isNull()
    ).rowsBetween(Window.unboundedPreceding, -1)
    neighbours = (
        ends.withColumn("before_end", F.max("w_end").over(back))
        .withColumn("after_start", F.min("w_start").over(ahead))
        .where(c("w_end").isNull())
        .drop("w_start", "w_end")
    )
    no = F.lit(False)
    seen = (
        neighbours.join(touched, keys, "left")
        .join(again, keys, "left")
        .fillna(False, subset=["taken", "overlaps", "again"])
    )
    exact = F.unix_micros("window_end") - F.unix_micros("window_start") == cell_us
    gaps = F.lit(not allow_gap) & ~c("taken")
    refused = (
        F.when(~exact, "not 168 hours")
        .when(c("again"), "already published")
        .when(c("taken") & F.lit(not replace), "week already published")
        .when(~c("taken") & F.lit(replace), "nothing to replace")
        .when(c("overlaps"), "overlaps a published week")
        .when(gaps & F.coalesce(c("before_end") < c("window_start"), no), "gap after the previous week")
        .when(gaps & F.coalesce(c("after_start") > c("window_end"), no), "gap before the next week")
    )
    return seen.select(*keys, refused.alias("refused"))


def publication_events(publications: DataFrame) -> DataFrame:
    """Publications as appended publish / withdraw events."""
    published = publications.select(
        "publication_id", "run_id", "team_id", "window_start", "window_end",
        F.lit("publish").alias("event"), c("published_at").alias("at"),
    )
    withdrawn = publications.where(c("withdrawn_at").isNotNull()).select(
        "publication_id", "run_id", "team_id", "window_start", "window_end",
        F.lit("withdraw").alias("event"), c("withdrawn_at").alias("at"),
    )
    return published.union(withdrawn)


def current_from_events(events: DataFrame) -> DataFrame:
    """Publications whose last event is a publish."""
    last = events.groupBy("publication_id").agg(
        F.max_by(F.struct("event", "run_id", "team_id", "window_end"), "at").alias("e")
    )
    return last.where(c("e.event") == "publish").select(
        "publication_id", c("e.run_id").alias("run_id"), c("e.team_id").alias("team_id"),
        c("e.window_end").alias("window_end"),
    )


def findings_on(findings: DataFrame) -> DataFrame:
    """Every finding a decision may name, one row each: rules, gaps, and the model's principle
    where it raised something."""
    raised = c("quality_state").isin("llm_flagged", "needs_review") & c("llm_principle_id").isNotNull()
    ids = F.concat(
        id_list(c("core_rule_ids")),
        id_list(c("readiness_rule_ids")),
        F.when(raised, F.array("llm_principle_id")).otherwise(F.array().cast("array<string>")),
    )
    return findings.select("run_id", *ALERT_KEY, F.explode(ids).alias("finding_id"))


def refused_decisions(decisions: DataFrame, findings: DataFrame, publications: DataFrame) -> DataFrame:
    """Decisions that may not be appended: not on a published week, not on that alert, or
    malformed."""
    published = current_publications(publications).select("run_id", F.lit(True).alias("is_published"))
    legal = findings_on(findings).distinct().withColumn("is_legal", F.lit(True))
    joined = decisions.join(published, "run_id", "left").join(
        legal, ["run_id", *ALERT_KEY, "finding_id"], "left"
    )
    why = (
        F.when(~c("state").isin(*K.DECISION_STATES), "unknown state")
        .when(F.coalesce(F.length(F.trim("note")), F.lit(0)) == 0, "a note is required")
        .when(F.length("note") > 2000, "the note is too long")
        .when(c("is_published").isNull(), "not a published week")
        .when(c("is_legal").isNull(), "not a finding on this alert")
    )
    return joined.withColumn("refused", why).where(c("refused").isNotNull()).drop(
        "is_published", "is_legal"
    )


def append_decisions(decisions: DataFrame, findings: DataFrame, publications: DataFrame) -> DataFrame:
    bad = refused_decisions(decisions, findings, publications)
    return decisions.join(bad.select("decision_id"), "decision_id", "left_anti")


def resolve_week(publications: DataFrame, team_id: str, week_end: str) -> DataFrame:
    return current_publications(publications).where(
        (c("team_id") == team_id) & (F.to_date("window_end") == F.lit(week_end).cast("date"))
    )
