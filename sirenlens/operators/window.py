"""Runs, the exact 168-hour window, its UTC day buckets, and scoping alerts to a team."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.instants import iso_instant
from sirenlens.functions.scalars import enc_text, stable_hash
from sirenlens.operators.attach import attach


@dataclass(frozen=True)
class RunSpec:
    """One run of one team. ``run_at`` is naive UTC and ends the window."""

    team_id: str
    run_at: datetime
    ruleset_version: str = K.RULESET_VERSION
    registry_version: str = "1"
    registry_sha256: str = ""
    registry_entry: str = "{}"
    model_version: str | None = "fake-model-1"
    display_name: str = ""


def run_id_of() -> Column:
    """Deterministic run id: the hash of everything that defines the run."""
    c = F.col
    return stable_hash(
        {
            "team_id": enc_text(c("team_id")),
            "run_at": enc_text(iso_instant(c("run_at"))),
            "window_start": enc_text(iso_instant(c("window_start"))),
            "registry_sha256": enc_text(c("registry_sha256")),
            "ruleset_version": enc_text(c("ruleset_version")),
            "prompt_version": enc_text(F.lit(K.PROMPT_VERSION)),
            "model_version": enc_text(c("model_version")),
            "app_version": enc_text(F.lit(K.APP_VERSION)),
        }
    )


def runs_table(spark: SparkSession, specs: list[RunSpec]) -> DataFrame:
    """The runs to compute together: every team and week is one row of one job."""
    rows = [
        (
            s.team_id,
            s.display_name or s.team_id,
            s.run_at.strftime("%Y-%m-%d %H:%M:%S.%f"),
            s.ruleset_version,
            s.registry_version,
            s.registry_sha256,
            s.registry_entry,
            s.model_version,
        )
        for s in specs
    ]
    schema = (
        "team_id string, team_display_name string, run_at_text string, ruleset_version string, "
        "registry_version string, registry_sha256 string, registry_entry_snapshot string, "
        "model_version string"
    )
    return (
        spark.createDataFrame(rows, schema)
        .withColumn("run_at", F.col("run_at_text").cast("timestamp"))
        .withColumn("window_start", F.col("run_at") - F.expr(f"INTERVAL {K.WINDOW_HOURS} HOURS"))
        .withColumn("window_end", F.col("run_at"))
        .withColumn("run_id", run_id_of())
        .drop("run_at_text")
    )


def day_buckets(runs: DataFrame) -> DataFrame:
    """One row per run and UTC date touched, with the hours of it inside the window."""
    last = F.col("window_end") - F.expr("INTERVAL 1 MICROSECOND")
    dated = runs.withColumn(
        "snapshot_date",
        F.explode(F.sequence(F.to_date("window_start"), F.to_date(last))),
    )
    start = F.greatest("window_start", F.col("snapshot_date").cast("timestamp"))
    end = F.least("window_end", F.date_add("snapshot_date", 1).cast("timestamp"))
    hours = (F.unix_micros("bucket_end") - F.unix_micros("bucket_start")) / F.lit(float(K.HOUR_US))
    return (
        dated.withColumn("bucket_start", start)
        .withColumn("bucket_end", end)
        .withColumn("covered_hours", hours)
    )


def in_window(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def team_scan(
    alerts: DataFrame, alert_schema: str, operators: list[str], start: datetime, end: datetime
) -> DataFrame:
    """One team's rows of one schema. All three predicates are literals, so they reach the
    scan; a team with no operator for the schema reads nothing."""
    return alerts.where(
        (F.col("alert_schema") == alert_schema)
        & F.col("operator").isin(operators)
        & in_window(F.col("ts"), F.lit(start), F.lit(end))
    )


def span_of(specs: list[RunSpec]) -> tuple[datetime, datetime]:
    ends = [s.run_at for s in specs]
    return min(ends) - timedelta(hours=K.WINDOW_HOURS), max(ends)


def scope_alerts(
    alerts: DataFrame,
    team_operators: DataFrame,
    runs: DataFrame,
    span: tuple[datetime, datetime],
) -> DataFrame:
    """Every alert row of every run: ownership is exact and case-sensitive.

    The literal ``span`` prunes the scan. The ownership side is configuration with a few schemas and
    operators, so the rows are never shuffled by these: see ``attach``.
    """
    owners = team_operators.join(
        runs.select("run_id", "team_id", "window_start", "window_end"), "team_id"
    )
    pruned = alerts.where(in_window(F.col("ts"), F.lit(span[0]), F.lit(span[1])))
    owned = attach(
        pruned, owners, ["alert_schema", "operator"], ["application", "key_field", "ts"], "inner"
    )
    return owned.where(in_window(F.col("ts"), F.col("window_start"), F.col("window_end")))


def reconcile_scan(scoped: DataFrame, expected: DataFrame) -> DataFrame:
    """Scanned rows against the source's own total per run and schema.

    ``expected`` is ``(run_id, alert_schema, reported_total)``; a difference in either
    direction, or a missing side, is not complete.
    """
    actual = scoped.groupBy("run_id", "alert_schema").agg(F.count("*").alias("scanned"))
    joined = expected.join(actual, ["run_id", "alert_schema"], "full_outer")
    scanned = F.coalesce("scanned", F.lit(0))
    total = F.coalesce("reported_total", F.lit(0))
    return joined.select(
        "run_id",
        "alert_schema",
        total.alias("reported_total"),
        scanned.alias("scanned"),
        (total == scanned).alias("complete"),
    )


def require_complete(checked: DataFrame) -> DataFrame:
    """Fail the job instead of publishing a partial week."""
    return checked.withColumn(
        "complete",
        F.when(F.col("complete"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("incomplete scan of run "), F.col("run_id")))
        ),
    )
