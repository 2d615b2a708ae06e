"""The configuration the registered queries run with: registry, runs and a scripted classifier.

Only configuration lives here; every alert comes from the given tables.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from sirenlens.operators.classify import ClassifierError
from sirenlens.operators.window import RunSpec, runs_table
from sirenlens.sources.registry import Registry, registry_from_string

RUN_AT = datetime(2024, 1, 15, 18)
WEEK_ENDS = [datetime(2024, 1, 8) + timedelta(days=7 * i) for i in range(4)]
MODEL = "fake-model-1"
FAN = 12  # identities per base key in the wide projection
TEAM_OPERATORS = [
    ("team-a", "v1", "op-a"),
    ("team-a", "v1", "op-b"),
    ("team-a", "v2", "OP-B"),
    ("team-b", "v1", "op-c"),
]


def _leaf(no: int, kind: str, field: str, op: str, *values: str, negated: bool = False,
          nested: bool = False) -> dict:
    return {
        "leaf_no": no,
        "kind": kind,
        "field": field,
        "op": op,
        "negated": negated,
        "operands": [{"kind": "literal", "value": v} for v in values],
        "nested": nested,
        "macro": False,
    }


REGISTRY = {
    "registry_version": "2024-01-01.1",
    "teams": [
        {
            "team_id": "team-a",
            "display_name": "Team A",
            "v1_operators": ["op-a", "op-b"],
            "v2_operator": "OP-B",
            "weekly_review": {"enabled": True},
            "panels": [
                {
                    "panel_id": "A1",
                    "schema": "v1",
                    "sql": "node_name <> 'test-node'",
                    "predicates": [_leaf(0, "comparison", "node_name", "<>", "test-node")],
                },
                {
                    "panel_id": "A2",
                    "schema": "v1",
                    "sql": "node_name NOT LIKE 'test%' AND application LIKE 'app-%'",
                    "predicates": [
                        _leaf(0, "like", "node_name", "LIKE", "test%", negated=True),
                        _leaf(1, "like", "application", "LIKE", "app-%"),
                    ],
                },
                {
                    "panel_id": "A3",
                    "schema": "v2",
                    "sql": "application <> 'app-2'",
                    "predicates": [_leaf(0, "comparison", "application", "<>", "app-2")],
                },
            ],
        },
        {
            "team_id": "team-b",
            "display_name": "Team B",
            "v1_operators": ["op-c"],
            "v2_operator": None,
            "weekly_review": {"enabled": True},
            "planning": {"v1_rule_effort_days": 1.5},
            "panels": [
                {
                    "panel_id": "B1",
                    "schema": "v1",
                    "sql": "application IN ('app-0','app-1') AND node_name <> 'test-node' "
                    "AND (node_name = 'node-1' OR severity = 'error')",
                    "predicates": [
                        _leaf(0, "in", "application", "IN", "app-0", "app-1"),
                        _leaf(1, "comparison", "node_name", "<>", "test-node"),
                        _leaf(2, "comparison", "node_name", "=", "node-1", nested=True),
                        _leaf(3, "comparison", "severity", "=", "error", nested=True),
                    ],
                },
            ],
        },
    ],
}


def registry(spark: SparkSession) -> Registry:
    return registry_from_string(spark, json.dumps(REGISTRY))


def window_specs() -> list[RunSpec]:
    """Both teams over one window that touches eight dates."""
    return [RunSpec(t, RUN_AT, display_name=t.title()) for t in ("team-a", "team-b")]


def _entry(team: str, end: datetime) -> str:
    """A stored registry entry. team-b's operators change in its last week, and its planning
    override (which is not measurement) appears with the second."""
    if team == "team-a":
        return '{"team_id":"team-a","v1_operators":["op-a","op-b"],"v2_operator":"OP-B","panels":[{"panel_id":"A1"}]}'
    operators = '["op-c"]' if end < WEEK_ENDS[3] else '["op-c","op-d"]'
    planning = "" if end < WEEK_ENDS[1] else ',"planning":{"v1_rule_effort_days":1.5}'
    return f'{{"team_id":"team-b","v1_operators":{operators},"v2_operator":null,"panels":[]{planning}}}'


def weekly_specs() -> list[RunSpec]:
    """Both teams, four Monday-aligned weeks. The rule set changes before team-a's last week."""
    return [
        RunSpec(
            team,
            end,
            ruleset_version="1.0.0" if team == "team-a" and end < WEEK_ENDS[3] else "1.1.0",
            registry_version="2024-01-01.1",
            registry_entry=_entry(team, end),
            model_version=MODEL,
            display_name=team.title(),
        )
        for team in ("team-a", "team-b")
        for end in WEEK_ENDS
    ]


def runs(spark: SparkSession, specs: list[RunSpec]) -> DataFrame:
    return runs_table(spark, specs)


# the scripted answers, by the first hex digit of an alert id modulo five
ANSWERS = (
    ("no_violation", "NONE", "high"),
    ("catalog_violation", "P3", "high"),
    ("catalog_violation", "P6", "medium"),
    ("other", "OTHER", "low"),
    ("no_violation", "NONE", "medium"),
)


def scripted_call(request_text: str, batch_id: str, attempt: int) -> str:
    """A deterministic classifier: some batches always fail, some fail once."""
    if batch_id[0] in "05a":
        raise ClassifierError("scripted timeout", "timeout")
    if batch_id[0] in "12b" and attempt == 1:
        return "{not valid json"
    request = json.loads(request_text)
    verdicts = []
    for alert in request["alerts"]:
        assessment, principle, confidence = ANSWERS[int(alert["alert_id"][0], 16) % 5]
        verdicts.append(
            {
                "alert_id": alert["alert_id"],
                "assessment": assessment,
                "principle_id": principle,
                "confidence": confidence,
                "justification": f"scripted {assessment}",
            }
        )
    return json.dumps({"batch_id": batch_id, "verdicts": verdicts})
