"""Column contracts shared by every source and operator."""

from __future__ import annotations

# one normalized alert event
ALERT_COLUMNS = (
    "alert_schema",
    "application",
    "key_field",
    "component",
    "message",
    "severity",
    "operator",
    "node_name",
    "network",
    "alert_rule_url",
    "provider",
    "status",
    "impact",
    "impact_kind",
    "runbook_url",
    "runbook_kind",
    "environment",
    "site",
    "time_created",
    "ts",
    "snapshot_date",
    "seq",
    "raw",
    "doc_hash",
)
# an alert's identity inside one run
IDENTITY = ("run_id", "alert_schema", "application", "key_field")

# --- fixed values: JSON fields of each document schema
DOCUMENT_FIELDS = {
    "v1": (
        "application",
        "object",
        "message",
        "severity",
        "operator",
        "key_field",
        "time_created",
        "node_name",
        "network",
        "alert_rule_url",
        "provider",
        "@timestamp",
    ),
    "v2": (
        "application",
        "component",
        "message",
        "severity",
        "status",
        "impact",
        "runbook_url",
        "environment",
        "site",
        "operator",
        "key_field",
        "time_created",
        "node_name",
        "network",
        "alert_rule_url",
        "provider",
        "@timestamp",
    ),
}
