"""Complete scans: what a job read against what its source holds.

A source's totals are kept in two small tables when its rows arrive: rows of each file, taken from the
Parquet footers, and rows of each schema, operator and hour. The pass that feeds the facts is
observed: its row count and an order-free checksum over runs and schemas come with the pass itself,
at no further read. Only where they differ from the totals are the rows counted run by run, and a
job with a short or a long run is refused before it writes a fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sirenlens.operators.window import in_window, reconcile_scan

c = F.col
EXACT = "decimal(38,0)"


class IncompleteScan(ValueError):
    """A run's rows are not the source's."""


def footer_counts(spark: SparkSession, path: str) -> DataFrame:
    """``file, rows`` of every Parquet file under ``path``. No column is read: the counts are those that the
    footers give for each row group."""
    files = spark.read.parquet(path).select(c("_metadata.file_path").alias("file"))
    return files.groupBy("file").agg(F.count("*").alias("rows"))


def file_problems(manifest: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Every file of ``manifest(keys, rows)`` and ``found(keys, rows)`` with its ``status``: ok, missing,
    unexpected, short or long."""
    wanted = manifest.select(*keys, c("rows").alias("expected"))
    joined = wanted.join(found.select(*keys, c("rows").alias("found")), keys, "full_outer")
    status = (
        F.when(c("found").isNull(), "missing")
        .when(c("expected").isNull(), "unexpected")
        .when(c("found") < c("expected"), "short")
        .when(c("found") > c("expected"), "long")
        .otherwise("ok")
    )
    return joined.select(*keys, "expected", "found", status.alias("status"))


def source_totals(alerts: DataFrame) -> DataFrame:
    """``alert_schema, operator, hour, rows``: what the source says it holds."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    return alerts.groupBy("alert_schema", "operator", hour).agg(F.count("*").alias("rows"))


def reported_totals(totals: DataFrame, team_operators: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, alert_schema, reported_total`` of every run and schema that its team has an operator for.

    Windows begin and end on the hour; another one is an error, since hours cannot be divided.
    """
    whole = (c("window_start") == F.date_trunc("hour", "window_start")) & (
        c("window_end") == F.date_trunc("hour", "window_end")
    )
    start = F.when(whole, c("window_start")).otherwise(
        F.raise_error(F.concat(F.lit("window does not begin and end on the hour: run "), c("run_id")))
    )
    owners = team_operators.join(
        runs.select("run_id", "team_id", start.alias("window_start"), "window_end"), "team_id"
    )
    held = totals.join(owners, ["alert_schema", "operator"]).where(
        in_window(c("hour"), c("window_start"), c("window_end"))
    )
    counted = held.groupBy("run_id", "alert_schema").agg(F.sum("rows").alias("reported_total"))
    asked = owners.select("run_id", "alert_schema").distinct()
    return asked.join(counted, ["run_id", "alert_schema"], "left").fillna(0, ["reported_total"])


def _mark() -> Column:
    return F.xxhash64("run_id", "alert_schema").cast(EXACT)


class ObservedScan:
    """``rows`` are those of ``scoped``, counted as the first action over them passes by."""

    def __init__(self, scoped: DataFrame, reported: DataFrame) -> None:
        self.scoped, self.reported = scoped, reported
        self.observation = Observation("scan")
        self.rows = scoped.observe(
            self.observation, F.count("*").alias("rows"), F.sum(_mark()).alias("mark")
        )

    def check(self) -> None:
        """Raise where the pass was not complete. A part of it that ran twice can only cause a recount."""
        seen = self.observation.get
        weight = c("reported_total").cast("decimal(18,0)")
        wanted = self.reported.agg(
            F.sum("reported_total").alias("rows"), F.sum(weight * F.xxhash64("run_id", "alert_schema")).cast(EXACT).alias("mark")
        ).first()
        if (seen["rows"], seen["mark"] or 0) == (wanted.rows or 0, wanted.mark or 0):
            return
        checked = reconcile_scan(self.scoped, self.reported).where(~c("complete"))
        short = checked.orderBy("run_id", "alert_schema").limit(20).collect()  # named in the message
        if short:
            named = ", ".join(f"{r.run_id[:12]} {r.alert_schema}: {r.scanned} of {r.reported_total}" for r in short)
            raise IncompleteScan(f"incomplete scan: {named}")
