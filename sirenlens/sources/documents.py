"""JSON alert documents (one per line) read as alert events.

The document stays a VARIANT until its fields are taken out, which keeps *absent*, *null* and
*not a string* apart for the readiness rules. Unusable rows are kept aside, never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.functions.instants import parse_instant
from sirenlens.functions.scalars import json_hash, severity_label
from sirenlens.sources.schema import ALERT_COLUMNS

# --- fixed values: JSON type -> type name written into evidence
KIND_NAMES = (("BOOLEAN", "bool"), ("BIGINT", "int"), ("STRING", "str"), ("VOID", "missing"))


def read_documents(spark: SparkSession, path: str, alert_schema: str) -> DataFrame:
    """Raw documents of one schema: ``alert_schema, raw, seq``."""
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.select(
        F.lit(alert_schema).alias("alert_schema"), "raw", F.xxhash64("raw").alias("seq")
    )


def read_both(spark: SparkSession, v1_path: str, v2_path: str) -> DataFrame:
    v1 = read_documents(spark, v1_path, "v1")
    return v1.unionByName(read_documents(spark, v2_path, "v2"), allowMissingColumns=True)


def _get(field: str) -> Column:
    return F.try_variant_get("document", f"$['{field}']", "variant")


def _text(field: str) -> Column:
    """Any scalar as text; objects and arrays as JSON text."""
    return F.try_variant_get("document", f"$['{field}']", "string")


def _kind(field: str) -> Column:
    """``missing`` (absent or null) or the evidence type name of what is there."""
    value = _get(field)
    name = F.schema_of_variant(value)
    kind = F.when(value.isNull(), "missing")
    for json_type, label in KIND_NAMES:
        kind = kind.when(name == json_type, label)
    return (
        kind.when(name.startswith("OBJECT"), "dict")
        .when(name.startswith("ARRAY"), "list")
        .otherwise("float")
    )


def normalize_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(alerts, quarantine)``: rows in the common schema, and rows without a usable document
    or ``@timestamp`` together with the reason."""
    v2 = F.col("alert_schema") == "v2"
    parsed = docs.withColumn("document", F.try_parse_json("raw"))
    shaped = parsed.select(
        "alert_schema",
        "raw",
        "seq",
        F.col("document").isNotNull().alias("is_json"),
        _text("@timestamp").alias("stamp"),
        _kind("@timestamp").alias("stamp_kind"),
        F.coalesce(_text("application"), F.lit("")).alias("application"),
        F.coalesce(_text("key_field"), F.lit("")).alias("key_field"),
        F.when(v2, _text("component")).otherwise(_text("object")).alias("component"),
        _text("message").alias("message"),
        _text("severity").alias("severity_text"),
        _kind("severity").alias("severity_kind"),
        _text("operator").alias("operator"),
        _text("node_name").alias("node_name"),
        _text("network").alias("network"),
        _text("alert_rule_url").alias("alert_rule_url"),
        _text("provider").alias("provider"),
        F.when(v2, _text("status")).alias("status"),
        F.when(v2, _kind("impact")).alias("impact_kind"),
        F.when(v2, _text("impact")).alias("impact_text"),
        F.when(v2, _kind("runbook_url")).alias("runbook_kind"),
        F.when(v2, _text("runbook_url")).alias("runbook_text"),
        F.when(v2, _text("environment")).alias("environment"),
        F.when(v2, _text("site")).alias("site"),
        _text("time_created").alias("time_created"),
    ).withColumn("ts", F.when(F.col("stamp_kind") == "str", parse_instant(F.col("stamp"))))
    reason = (
        F.when(~F.col("is_json"), "not a JSON document")
        .when(F.col("ts").isNull(), "unusable @timestamp")
        .when(F.col("severity_text").rlike(r"\A\s*--+\d+\s*\z"), "unusable severity")
    )
    marked = shaped.withColumn("reason", reason)
    # a number that is not whole is nobody's code: it is kept as written
    severity = F.when(F.col("severity_kind").isin("float", "bool"), F.col("severity_text"))
    alerts = marked.where(F.col("reason").isNull()).select(
        "*",
        F.coalesce(severity, severity_label(F.col("alert_schema"), F.col("severity_text"))).alias(
            "severity"
        ),
        F.when(F.col("impact_kind") == "str", F.col("impact_text")).alias("impact"),
        F.when(F.col("runbook_kind") == "str", F.col("runbook_text")).alias("runbook_url"),
        F.to_date("ts").alias("snapshot_date"),
        json_hash(F.col("raw")).alias("doc_hash"),
    )
    quarantine = marked.where(F.col("reason").isNotNull()).select(
        "alert_schema", "raw", "seq", "reason"
    )
    return alerts.select(*ALERT_COLUMNS), quarantine
