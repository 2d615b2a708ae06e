"""The generic ``events`` table read as alert events.

The projection is plain column arithmetic, so column pruning and the time-range filter reach
the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.functions.instants import iso_instant
from sirenlens.functions.scalars import enc_int, enc_text, severity_label, stable_hash
from sirenlens.sources.schema import ALERT_COLUMNS

# identical text in Spark SQL and in ANSI SQL engines; {key} varies how many identities there are
PROJECTION = """
SELECT
  event_id, ts AS event_ts,
  CASE WHEN g % 3 = 2 THEN 'v2' ELSE 'v1' END AS alert_schema,
  CASE WHEN g % 4 = 0 THEN 'op-a' WHEN g % 4 = 1 THEN 'op-b' WHEN g % 4 = 2 THEN 'OP-B' ELSE 'op-c' END AS operator,
  CONCAT('app-', CAST(g % 5 AS STRING)) AS application,
  {key} AS key_field,
  CASE WHEN g % 7 = 3 THEN 'Unknown' ELSE CONCAT('comp-', CAST(g % 6 AS STRING)) END AS component,
  CASE WHEN event_id % 11 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 13 = 0 THEN 'test-node'
       ELSE CONCAT('node-', CAST(user_id % 4 AS STRING)) END AS node_name,
  CASE WHEN event_id % 17 = 0 AND g % 5 = 1 THEN '  Error   Occurred. ' WHEN event_id % 19 = 0 AND g % 5 = 2 THEN 'I am alive!'
       ELSE CONCAT('value ', CAST(event_id % 97 AS STRING), ' above limit') END AS message,
  CASE WHEN event_type = 'view' AND g % 8 > 1 AND event_id % 2 = 0 THEN 1 WHEN event_type = 'error' THEN 5
       WHEN event_type = 'purchase' THEN 4 ELSE 3 END AS severity_code,
  CASE WHEN event_type = 'view' AND g % 8 > 1 AND event_id % 2 = 0 THEN 'resolved' ELSE 'firing' END AS status,
  CASE WHEN g % 2 = 0 THEN 'grafana' ELSE 'api' END AS provider,
  CASE WHEN g % 2 = 0 AND (event_id % 23 <> 0 OR g % 6 <> 0) THEN CONCAT('https://grafana.example/d/', CAST(g % 8 AS STRING))
       ELSE CAST(NULL AS STRING) END AS alert_rule_url,
  CASE WHEN g % 7 = 4 AND event_id % 3 = 0 THEN 'not-a-time' WHEN g % 7 = 4 AND event_id % 3 = 1 THEN '2024-01-12T00:00:00.000Z'
       WHEN g % 7 = 5 AND event_id % 9 = 0 THEN CAST(NULL AS STRING) ELSE CAST(CAST(ts AS DATE) AS STRING) END AS time_created,
  CASE WHEN g % 9 = 2 THEN CAST(NULL AS STRING) WHEN g % 9 = 5 THEN 'High CPU.' ELSE 'Checkout is slow' END AS impact,
  CASE WHEN g % 6 = 2 THEN 'mailto:x@example.com' ELSE 'https://runbooks.example/a' END AS runbook_url
FROM (SELECT *, CASE WHEN user_id % 10 < 3 THEN user_id % 3 ELSE 3 + user_id % 40 END AS g FROM events) e
"""
NARROW_KEY = "CONCAT('key-', CAST(g AS STRING))"
WIDE_KEY = "CONCAT('key-', CAST(g AS STRING), '-', CAST(event_id % {fan} AS STRING))"


def key_expression(fan: int | None) -> str:
    return NARROW_KEY if fan is None else WIDE_KEY.replace("{fan}", str(fan))


def document_fields(fields: dict[str, Column]) -> dict[str, Column]:
    """Encode the typed columns of a projected event as document fields."""
    return {
        name: (enc_int(c) if name == "severity" else enc_text(c)) for name, c in fields.items()
    }


def _document_hash() -> Column:
    """The document hash of a projected event: its fields in the stable encoding."""
    c = F.col
    shared = {
        "application": c("application"),
        "message": c("message"),
        "severity": c("severity_code"),
        "operator": c("operator"),
        "key_field": c("key_field"),
        "time_created": c("time_created"),
        "node_name": c("node_name"),
        "alert_rule_url": c("alert_rule_url"),
        "provider": c("provider"),
        "@timestamp": iso_instant(c("ts")),
    }
    v1 = document_fields({**shared, "object": c("component")})
    v2 = document_fields(
        {
            **shared,
            "component": c("component"),
            "status": c("status"),
            "impact": c("impact"),
            "runbook_url": c("runbook_url"),
        }
    )
    return F.when(c("alert_schema") == "v2", stable_hash(v2)).otherwise(stable_hash(v1))


def alerts_from_events(spark: SparkSession, sf_dir: str, fan: int | None = None) -> DataFrame:
    """Alert events in the common schema, from ``events.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return alerts_from_table(events, fan)


def alerts_from_table(events: DataFrame, fan: int | None = None) -> DataFrame:
    rows = events.sparkSession.sql(
        PROJECTION.replace("{key}", key_expression(fan)).replace(
            "FROM events)", "FROM {events})"
        ),
        events=events,
    )
    v2 = F.col("alert_schema") == "v2"
    text = F.lit(None).cast("string")
    prepared = rows.withColumn("ts", F.col("event_ts").cast("timestamp"))
    hashed = prepared.withColumn("doc_hash", _document_hash())
    return hashed.select(
        "alert_schema",
        "application",
        "key_field",
        "component",
        "message",
        severity_label(F.col("alert_schema"), F.col("severity_code").cast("string")).alias(
            "severity"
        ),
        "operator",
        "node_name",
        text.alias("network"),
        "alert_rule_url",
        "provider",
        F.when(v2, F.col("status")).alias("status"),
        F.when(v2, F.col("impact")).alias("impact"),
        F.when(v2, F.when(F.col("impact").isNull(), "missing").otherwise("str")).alias(
            "impact_kind"
        ),
        F.when(v2, F.col("runbook_url")).alias("runbook_url"),
        F.when(v2, F.when(F.col("runbook_url").isNull(), "missing").otherwise("str")).alias(
            "runbook_kind"
        ),
        text.alias("environment"),
        text.alias("site"),
        "time_created",
        "ts",
        F.to_date("ts").alias("snapshot_date"),
        F.col("event_id").alias("seq"),
        text.alias("raw"),
        "doc_hash",
    ).select(*ALERT_COLUMNS)
