"""The stored facts the published queries read, computed once per session and data folder."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.operators.planning import run_health, week_outcomes
from sirenlens.operators.published import Store, all_rule_ids
from sirenlens.operators.window import span_of
from sirenlens.plans import sample
from sirenlens.plans.team_week import Analysis, Facts, compute_facts
from sirenlens.session import materialize, ship_package, together, tune
from sirenlens.sources.events import alerts_from_events

c = F.col
NOW = datetime(2024, 1, 30, 12)


def publications_of(runs: DataFrame) -> DataFrame:
    """Every run published six hours after its week; one withdrawn, one re-published once."""
    published = runs.select(
        "run_id", "team_id", "window_start", "window_end",
        (c("window_end") + F.expr("INTERVAL 6 HOURS")).alias("published_at"),
        F.lit("operator").alias("published_by"),
        F.lit(None).cast("string").alias("review_note"),
    )
    week2 = c("window_end") == F.lit(sample.WEEK_ENDS[1])
    withdrawn = F.when((c("team_id") == "team-b") & week2, c("published_at") + F.expr("INTERVAL 1 DAY"))
    current = published.withColumn("withdrawn_at", withdrawn).withColumn("copy", F.lit(1))
    replaced = (
        published.where((c("team_id") == "team-a") & week2)
        .withColumn("withdrawn_at", c("published_at"))
        .withColumn("published_at", c("published_at") - F.expr("INTERVAL 1 HOUR"))
        .withColumn("copy", F.lit(0))
    )
    team = F.when(c("team_id") == "team-a", 0).otherwise(1)
    week = F.datediff("window_end", F.lit(sample.WEEK_ENDS[0]).cast("date")) / 7
    number = (week * 4 + team * 2 + c("copy") + 1).cast("long")
    return current.unionByName(replaced).withColumn("publication_id", number).drop("copy")


def decisions_of(findings: DataFrame) -> DataFrame:
    """Human decisions on rule findings of the stored alerts, some of them revised."""
    single = findings.select(
        "team_id", "run_id", "alert_schema", "application", "key_field", "row_count", "last_seen",
        F.explode(all_rule_ids()).alias("finding_id"),
    )
    rounds = F.when(c("row_count") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = single.withColumn("round", F.explode(rounds))
    state = F.element_at(
        F.array(F.lit("pending"), F.lit("confirmed"), F.lit("dismissed")),
        ((c("row_count") + c("round")) % 3 + 1).cast("int"),
    )
    identity = F.concat_ws(
        "|", "run_id", "alert_schema", "application", "key_field", "finding_id",
        c("round").cast("string"),
    )
    return spread.select(
        F.conv(F.substring(F.sha2(identity, 256), 1, 12), 16, 10).cast("long").alias("decision_id"),
        "team_id", "run_id", "alert_schema", "application", "key_field", "finding_id",
        state.alias("state"),
        F.concat(F.lit("round "), c("round").cast("string")).alias("note"),
        (c("last_seen") + F.make_dt_interval(c("round") + 1)).alias("decided_at"),
        F.lit("reviewer").alias("decided_by"),
    )


def schedule_log(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """The schedule's log: each week's outcome on the day it became due, derived from its health
    with nothing held before."""
    empty = runs.limit(0).select(
        "team_id", "window_end", c("run_at").alias("invoked_at"), F.lit("").alias("outcome")
    )
    health = run_health(runs, findings).withColumn("failed", F.lit(False))
    outcomes = week_outcomes(health, empty, NOW)
    number = (
        F.datediff("window_end", F.lit(sample.WEEK_ENDS[0]).cast("date")) / 7 * 2
        + F.when(c("team_id") == "team-a", 1).otherwise(2)
    ).cast("long")
    return outcomes.select(
        number.alias("log_id"),
        (c("window_end") + F.expr("INTERVAL 5 HOURS")).alias("invoked_at"),
        "team_id", "window_end", "outcome", "run_id",
        c("problems").alias("detail"),
    )


@dataclass(frozen=True)
class Tables:
    store: Store
    facts: Facts


_stores: dict[tuple[str, ...], Tables] = {}
_analyses: dict[tuple[str, ...], Analysis] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """A session, a folder, and the state of its events: changed files are another key."""
    path = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        c("_metadata.file_path"), c("_metadata.file_size"), c("_metadata.file_modification_time")
    )
    state = path.distinct().agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), str(state))


def forget() -> None:
    """Drop the one-window and weekly analyses, so that a timed query does all its work; stored facts stay."""
    _analyses.clear()


def stored(spark: SparkSession, sf_dir: str) -> Tables:
    """Facts of every team and week of ``events``, written once and read by every caller."""
    key = _key(spark, sf_dir)
    if key not in _stores:
        ship_package(tune(spark))
        specs = sample.weekly_specs()
        alerts = alerts_from_events(spark, sf_dir, sample.FAN)
        f = compute_facts(
            alerts, sample.registry(spark), sample.runs(spark, specs), span_of(specs),
            sample.scripted_call,
        )
        assert f.batches and f.attempts and f.new_verdicts and f.outcomes

        def written(**tables: DataFrame) -> list[DataFrame]:
            return together(*[lambda n=n, d=d: materialize(d, n) for n, d in tables.items()])

        runs, metrics, counts, findings, panels, attempts, verdicts = written(
            runs=f.runs, metrics=f.daily_metrics, counts=f.daily_rule_counts,
            findings=f.alert_findings, panels=f.run_panels, attempts=f.attempts,
            verdicts=f.new_verdicts,
        )
        publications, decisions, log = written(
            publications=publications_of(runs), decisions=decisions_of(findings),
            log=schedule_log(runs, findings),
        )
        kept = Facts(
            runs, metrics, counts, findings, panels, f.batches, attempts, verdicts, f.outcomes, f.members
        )
        store = Store(runs, metrics, counts, findings, publications, decisions, log)
        _stores[key] = Tables(store, kept)
    return _stores[key]


def window_analysis(spark: SparkSession, sf_dir: str, fan: int | None = None) -> Analysis:
    """The one-window analysis of both teams; what several facts read is written when first asked for."""
    key = (*_key(spark, sf_dir), str(fan))
    if key not in _analyses:
        tune(spark)
        specs = sample.window_specs()
        _analyses[key] = Analysis(
            alerts_from_events(spark, sf_dir, fan),
            sample.registry(spark),
            sample.runs(spark, specs),
            span_of(specs),
            cut=True,
        )
    return _analyses[key]


def weekly_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    key = (*_key(spark, sf_dir), "weekly")
    if key not in _analyses:
        tune(spark)
        specs = sample.weekly_specs()
        _analyses[key] = Analysis(
            alerts_from_events(spark, sf_dir, sample.FAN),
            sample.registry(spark),
            sample.runs(spark, specs),
            span_of(specs),
            cut=True,
        )
    return _analyses[key]
