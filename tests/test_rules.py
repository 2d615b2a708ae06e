from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sirenlens.operators import rules as R
from sirenlens.sources.documents import normalize_documents
from tests.rows import T0, alert, frame


def judged(spark, rows):
    marked = R.with_rule_mask(frame(spark, rows)).orderBy("seq")
    return [r[0] for r in marked.select(R.mask_ids(F.col("rule_mask"), R.ROW_RULES)).collect()]


def test_core_rule_boundaries(spark):
    day, ms = timedelta(hours=24), timedelta(milliseconds=1)
    rows = [
        alert(seq=0),
        alert(seq=1, provider="api", alert_rule_url=None),
        alert(seq=2, time_created=(T0 - day).isoformat()),
        alert(seq=3, message="Error Occurred"),
        alert(seq=4, message="i am alive"),
        alert(seq=5, component="Unknown"),
        alert(seq=6, alert_rule_url=" "),
        alert(seq=7, time_created=(T0 + ms).isoformat()),
        alert(seq=8, time_created=(T0 - day - ms).isoformat()),
        alert(seq=9, node_name=""),
        alert(seq=10, node_name=" Test "),
        alert(seq=11, operator=None),
        alert(seq=12, time_created="12:00"),
        alert(seq=13, provider=" Grafana", alert_rule_url=None),
    ]
    assert judged(spark, rows) == [
        [], [], [], ["R1"], ["R2"], ["R3"], ["R4"], ["R7"], ["R7"], [], ["R3"], ["R3"], ["R7"], ["R4"],
    ]


def test_readiness_rules(spark):
    rows = [
        alert(alert_schema="v2", seq=0),
        alert(alert_schema="v2", seq=1, impact=None, impact_kind="missing"),
        alert(alert_schema="v2", seq=2, impact=None, impact_kind="int"),
        alert(alert_schema="v2", seq=3, impact=" N/A "),
        alert(alert_schema="v2", seq=4, runbook_url="mailto:x@y", severity="critical"),
        alert(alert_schema="v2", seq=5, runbook_url=None, runbook_kind="missing"),
        alert(alert_schema="v2", seq=6, impact="High CPU!"),
        alert(alert_schema="v2", seq=7, impact="high cpu causes latency"),
        alert(alert_schema="v2", seq=8, time_created=None),
    ]
    assert judged(spark, rows) == [[], ["R8"], ["R8"], ["R8"], ["R9"], ["R9"], ["R10"], [], []]
    ready = R.with_rule_mask(frame(spark, rows)).orderBy("seq").select(
        R.completion_ready(F.col("rule_mask"), F.col("severity"))
    ).collect()
    # a missing runbook blocks only a critical alert
    assert [r[0] for r in ready] == [True, False, False, False, False, True, False, True, True]


def test_phase(spark):
    cases = [(0, 0, None, "no_data"), (1, 0, None, "phase_0"), (1, 1, 50.0, "phase_1"), (0, 2, 99.9, "phase_2"),
             (0, 2, 100.0, "done"), (0, 2, None, "phase_2")]
    df = spark.createDataFrame(cases, "a long, b long, p double, want string")
    rows = df.select(R.phase_of(F.col("a"), F.col("b"), F.col("p")), "want").collect()
    assert all(r[0] == r[1] for r in rows)


def test_evidence_names_what_matched(spark):
    rows = [alert(seq=0, component="Unknown", node_name="test", operator=" "), alert(seq=1, time_created=None)]
    found = {(r.seq, r.rule_id): r.evidence for r in R.row_findings(frame(spark, rows)).collect()}
    assert found[(0, "R3")] == (
        '{"violations":[{"field":"operator","reason":"empty"},{"field":"object","reason":"placeholder",'
        '"normalized":"unknown"},{"field":"node_name","reason":"placeholder","normalized":"test"}]}'
    )
    assert found[(1, "R7")] == '{"reason":"missing","time_created":null}'


def test_documents_keep_absent_null_and_other_types_apart(spark):
    docs = [
        ("v2", '{"application":"a","key_field":1,"@timestamp":"2026-08-23T12:00:00Z","impact":null,"severity":5}', 1),
        ("v2", '{"application":"a","key_field":"k","@timestamp":"2026-08-23T12:00:00Z","impact":7,"runbook_url":["x"]}', 2),
        ("v1", '{"object":"o","@timestamp":"2026-08-23 12:00","impact":"x","severity":"4"}', 3),
        ("v1", '{"@timestamp":5}', 4),
        ("v1", "nope", 5),
        ("v1", '{"@timestamp":"2026-08-23T12:00:00Z","severity":true}', 6),
    ]
    good, bad = normalize_documents(spark.createDataFrame(docs, "alert_schema string, raw string, seq long"))
    rows = {r.seq: r for r in good.collect()}
    assert (rows[1].impact_kind, rows[1].runbook_kind, rows[1].severity, rows[1].key_field) == ("missing", "missing", "critical", "1")
    assert (rows[2].impact_kind, rows[2].impact, rows[2].runbook_kind) == ("int", None, "list")
    assert (rows[3].component, rows[3].application, rows[3].severity, rows[3].impact) == ("o", "", "major", None)
    assert rows[6].severity == "true"
    assert {r.seq: r.reason for r in bad.collect()} == {4: "unusable @timestamp", 5: "not a JSON document"}
