"""Plain-language labels per rule and firing pattern, as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: rule id -> (problem, action, fix, why)
RULE_LABELS = {
    "R1": (
        "Generic message",
        "Rewrite generic messages",
        "Say what failed, where and by how much.",
        "The message doesn't say what failed.",
    ),
    "R2": (
        "Heartbeat",
        "Delete heartbeat alerts",
        "Delete it. A status belongs in logs, not in alerts.",
        "It reports a status, not a problem.",
    ),
    "R3": (
        "Placeholder name",
        "Replace placeholder names",
        "Use the real application, component or operator name.",
        "A name is empty or a placeholder.",
    ),
    "R4": (
        "No rule link",
        "Add the Grafana rule link",
        "Set alert_rule_url to the Grafana alert rule.",
        "Responders can't open the Grafana rule that fired.",
    ),
    "R5": (
        "Hidden in panel",
        "Stop hiding alerts in panels",
        "Fix or delete the alert at its source, then remove the panel filter.",
        "Every panel you own filters it out.",
    ),
    "R6": (
        "Firing pattern",
        "Fix stuck, spamming or flapping alerts",
        "Fix the condition so the alert clears once the problem is handled.",
        "It fires in a stuck, spamming or flapping pattern.",
    ),
    "R7": (
        "Bad creation time",
        "Stamp the creation time correctly",
        "Stamp time_created when the problem is detected, in UTC.",
        "time_created is outside the 24 hours before it arrived.",
    ),
    "R8": (
        "No impact",
        "Add an impact",
        "Say what users experience while it fires.",
        "No impact is stated.",
    ),
    "R9": (
        "No runbook",
        "Add a runbook",
        "Add an https link to the runbook.",
        "There is no usable runbook link.",
    ),
    "R10": (
        "Impact is a cause",
        "Describe impact as what users see",
        "Describe what users see, not the cause.",
        "The impact names a cause, not what users see.",
    ),
}
# --- fixed values: R6 firing pattern -> (problem, fix, why)
PATTERN_LABELS = {
    "stuck": (
        "Stuck",
        "Make it clear once the problem is handled, or delete it.",
        "It kept firing for 72 hours or more without clearing.",
    ),
    "spamming": (
        "Spamming",
        "Send it once when it fires and once when it clears.",
        "It sent 24 or more events a day.",
    ),
    "flapping": (
        "Flapping",
        "Add a pending period so it stops toggling.",
        "It fired and cleared 3 or more times in a day.",
    ),
}
# --- fixed values: a missing runbook on a critical alert
CRITICAL_RUNBOOK = (
    "Critical, no runbook",
    "A critical alert has no usable runbook link. This blocks phase 2.",
)
# --- fixed values: quality state -> label
STATE_LABELS = {
    "rule_flagged": "Flagged",
    "llm_flagged": "Advisory",
    "needs_review": "Needs decision",
    "assessed_good": "No issue",
    "unassessed": "Not reviewed",
}


def label_rows() -> list[tuple[str, str, bool, str, str, str, str]]:
    rows = []
    for rule, (problem, action, fix, why) in RULE_LABELS.items():
        rows.append((rule, "", False, problem, action, fix, why))
        if rule == "R6":
            for pattern, (p, f, w) in PATTERN_LABELS.items():
                rows.append((rule, pattern, False, p, action, f, w))
        if rule == "R9":
            rows.append((rule, "", True, CRITICAL_RUNBOOK[0], action, fix, CRITICAL_RUNBOOK[1]))
    return rows


def rule_labels(spark: SparkSession) -> DataFrame:
    """One row per rule, R6 pattern and critical R9: the join side of the label lookup."""
    return spark.createDataFrame(
        label_rows(),
        "rule_id string, pattern string, critical boolean, problem string, action string, "
        "fix string, why string",
    )
