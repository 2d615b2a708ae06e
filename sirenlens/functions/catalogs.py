"""Fixed values of the rule set: phrase lists, thresholds, ids and versions."""

from __future__ import annotations

# --- fixed values: phrases, in normalized form (lowercase, single-spaced, no outer punctuation)
GENERIC_MESSAGES = (
    "error occurred",
    "something went wrong",
    "unable to get data",
    "alert triggered",
    "issue detected",
)
HEARTBEAT_MESSAGES = (
    "i am alive",
    "ok",
    "healthy",
    "started",
    "completed",
    "running",
    "service started",
    "process running",
    "completed successfully",
)
PLACEHOLDERS = ("unknown", "test", "default", "n/a")
TECHNICAL_IMPACTS = ("high cpu", "high cpu usage", "cpu usage is high", "cpu is high")

# --- fixed values: ids
CORE_RULES = ("R1", "R2", "R3", "R4", "R5", "R6", "R7")
READINESS_RULES = ("R8", "R9", "R10")
ALL_RULES = CORE_RULES + READINESS_RULES
PRINCIPLES = ("P1", "P2", "P3", "P4", "P5", "P6", "P7", "P8", "P9", "P10", "P11")
CITABLE = ALL_RULES + PRINCIPLES
# order of findings inside one row's evidence
EVIDENCE_ORDER = ("R1", "R2", "R3", "R4", "R7", "R6", "R5", "R8", "R9", "R10")
SCHEMAS = ("v1", "v2")
QUALITY_STATES = ("rule_flagged", "llm_flagged", "needs_review", "assessed_good", "unassessed")
PHASES = ("no_data", "phase_0", "phase_1", "phase_2", "done")
FIRE_PATTERNS = ("flapping", "spamming", "stuck")
ASSESSMENTS = ("no_violation", "catalog_violation", "other")
CONFIDENCES = ("high", "medium", "low")
DECISION_STATES = ("pending", "confirmed", "dismissed")

# --- fixed values: thresholds
WINDOW_HOURS = 168
WINDOW_DAYS = 7
MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US
FLAP_WINDOW_US = 24 * HOUR_US
FLAP_CYCLES = 3
SPAM_PER_DAY = 24
SPAM_MIN_SPAN_US = 6 * HOUR_US
STUCK_OPEN_US = 72 * HOUR_US
MAX_BATCH = 200
MAX_ATTEMPTS = 3
MAX_JUSTIFICATION = 1000
RETENTION_DAYS = 84
HOLD_DAYS = 3
EFFORT_DAYS_PER_RULE = 0.5
WORKING_DAYS = 5

# --- fixed values: versions frozen onto a run
RULESET_VERSION = "1.1.0"
PROMPT_VERSION = "1.3.0"
PARSER_VERSION = "1.1.0"
APP_VERSION = "0.1.0"

# --- fixed values: severity names by code, (v1, v2)
SEVERITY_NAMES = {
    5: ("error", "critical"),
    4: ("major", "high"),
    3: ("warning", "warning"),
    1: ("clear", "clear"),
}

# --- fixed values: panel field classes and the alert column behind each field
INSTANCE_FIELDS = (
    "node_name",
    "message",
    "object",
    "component",
    "key_field",
    "alert_rule_url",
    "application",
)
CLASSIFICATION_FIELDS = ("severity", "environment", "status", "provider", "operator")
IDENTITY_FIELDS = ("operator", "application", "node_name", "object", "component")
MECHANICAL_MACROS = ("__timeFilter", "__timeFrom", "__timeTo", "__interval")
