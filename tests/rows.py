"""Hand-written alert rows for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from sirenlens.sources.schema import ALERT_COLUMNS

TYPES = {"ts": "timestamp", "snapshot_date": "date", "seq": "long"}
SCHEMA = ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in ALERT_COLUMNS)
T0 = datetime(2026, 8, 23, 12)


def alert(ts: datetime = T0, seq: int = 0, **fields) -> dict:
    schema = fields.get("alert_schema", "v1")
    base = dict.fromkeys(ALERT_COLUMNS)
    base.update(
        alert_schema=schema,
        application="app",
        key_field="key",
        component="comp",
        message="Checkout error rate above 2%",
        severity="error" if schema == "v1" else "high",
        operator="op",
        node_name="node-a",
        alert_rule_url="https://grafana.internal/d/1",
        provider="grafana",
        time_created=ts.isoformat(),
        ts=ts,
        snapshot_date=ts.date(),
        seq=seq,
        doc_hash=f"h{seq}",
    )
    if schema == "v2":
        base.update(status="firing", impact="Customers see errors", impact_kind="str",
                    runbook_url="https://runbooks.internal/a", runbook_kind="str")
    base.update(fields)
    return base


def frame(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r[n] for n in ALERT_COLUMNS) for r in rows], SCHEMA)


def every(start: datetime, step: timedelta, n: int) -> list[datetime]:
    return [start + i * step for i in range(n)]
