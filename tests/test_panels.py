from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sirenlens.operators.window import RunSpec, runs_table, span_of
from sirenlens.plans.sample import _leaf
from sirenlens.plans.team_week import Analysis, compute_facts
from sirenlens.sources.registry import registry_from_string, registry_problems
from tests.rows import alert, frame

RUN_AT = datetime(2026, 8, 25, 18)
DAY1 = datetime(2026, 8, 23, 12)


def registry(spark, panels, operators=("op",), v2=None):
    team = {"team_id": "t", "display_name": "T", "v1_operators": list(operators), "v2_operator": v2, "panels": panels}
    return registry_from_string(spark, json.dumps({"registry_version": "1", "teams": [team]}))


def panel(name, *predicates, schema="v1", **more):
    return {"panel_id": name, "schema": schema, "sql": name, "predicates": list(predicates), **more}


def analysis(spark, rows, panels, **kw):
    specs = [RunSpec("t", RUN_AT)]
    return Analysis(frame(spark, rows), registry(spark, panels, **kw), runs_table(spark, specs), span_of(specs))


def by_key(a):
    return {r.key_field: (r.core_ids, r.unseen) for r in a.identities.collect()}


def rows_on(*nodes, **more):
    return [alert(DAY1, i, key_field=f"k{i}", node_name=n, **more) for i, n in enumerate(nodes)]


def test_unanimity_and_blast_radius(spark):
    one = panel("p1", _leaf(0, "comparison", "node_name", "<>", "junk"))
    two = panel("p2", _leaf(0, "in", "NODE_NAME", "IN", "junk", "other", negated=True))
    a = analysis(spark, rows_on("junk", "other", "a", "b", None), [one, two])
    assert by_key(a) == {"k0": (["R5"], False), "k1": ([], False), "k2": ([], False), "k3": ([], False), "k4": ([], False)}
    # 3 of 5 rows: the leaf is unmeasured and nothing is suppressed; exactly half still applies
    wide = analysis(spark, rows_on("junk", "junk", "junk", "a", "b"), [one])
    assert all(not ids for ids, _ in by_key(wide).values())
    assert [r.suppression_unmeasured for r in wide.unmeasured.collect()] == [1]
    half = analysis(spark, rows_on("junk", "junk", "a", "b"), [one])
    assert sorted(k for k, (ids, _) in by_key(half).items() if ids) == ["k0", "k1"]


def test_unparseable_panel_blocks_unanimity_and_counts_twice(spark):
    good = panel("p1", _leaf(0, "comparison", "node_name", "!=", "junk"))
    broken = panel("p2", parse_state="unparseable", parse_error="expected FROM")
    a = analysis(spark, rows_on("junk", "a", "b"), [good, broken])
    assert all(not ids for ids, _ in by_key(a).values())
    assert [(r.suppression_unmeasured, r.unseen_unmeasured) for r in a.unmeasured.collect()] == [(1, 1)]


def test_unseen_is_disjoint_from_suppressed_and_null_without_panel(spark):
    narrow = panel(
        "p",
        _leaf(0, "comparison", "application", "=", "shown"),
        _leaf(1, "comparison", "node_name", "=", "n1", nested=True),
        _leaf(2, "comparison", "node_name", "!=", "junk"),
    )
    rows = [
        alert(DAY1, 0, key_field="other", application="hidden-app", node_name="n1"),
        alert(DAY1, 1, key_field="shown", application="shown", node_name="n1"),
        alert(DAY1, 2, key_field="junk", application="shown", node_name="junk"),
        alert(DAY1, 3, key_field="or", application="shown", node_name="n2"),
        alert(DAY1, 4, key_field="both", application="hidden-app", node_name="junk"),
        alert(DAY1, 5, alert_schema="v2", key_field="v2", operator="op2"),
    ]
    a = analysis(spark, rows, [narrow], v2="op2")
    assert by_key(a) == {"other": ([], True), "shown": ([], False), "junk": (["R5"], False), "or": ([], False),
                         "both": (["R5"], False), "v2": ([], None)}


def test_like_spans_newlines_and_has_no_escape(spark):
    from sirenlens.operators.suppression import like_matches

    cases = [("a\nb", "a%", True), ("a\nb", "a_b", True), ("abc", "a%c", True), ("a.c", "a.c", True), ("abc", "a.c", False),
             ("A", "a", False), ("x\\y", "x\\y", True), ("50%", "50%", True), ("ab\n", "ab", True), (None, "%", None),
             ("", "%", True), ("abc", "%b%", True), ("a[b]", "%[b]", True)]
    df = spark.createDataFrame(cases, "v string, p string, want boolean")
    for r in df.select(like_matches(F.col("v"), F.col("p")).alias("got"), "*").collect():
        assert r.got == r.want, r


def test_multi_date_identity_and_daily_facts(spark):
    d2 = DAY1 + timedelta(days=1)
    rows = [alert(DAY1, 0), alert(DAY1, 1), alert(d2, 2, message="Alert triggered"),
            alert(DAY1, 3, key_field="k2", node_name=None), alert(RUN_AT, 4, key_field="late")]
    specs = [RunSpec("t", RUN_AT)]
    f = compute_facts(frame(spark, rows), registry(spark, []), runs_table(spark, specs), span_of(specs))
    days = {str(r.snapshot_date): r for r in f.daily_metrics.where("alert_schema = 'v1' AND alerts > 0").collect()}
    assert set(days) == {"2026-08-23", "2026-08-24"}
    first, second = days["2026-08-23"], days["2026-08-24"]
    assert (first.alerts, first.distinct_alerts, first.flagged_by_rule, first.unassessed, first.unseen) == (3, 2, 0, 1, None)
    assert (second.alerts, second.flagged_by_rule, second.flagged_by_rule_distinct) == (1, 1, 1)
    assert (first.node_name_numerator, first.node_name_denominator, first.key_inflation_denominator) == (1, 1, 1)
    assert f.daily_metrics.count() == 16
    states = {r.key_field: (r.quality_state, r.core_rule_ids, r.row_count) for r in f.alert_findings.collect()}
    assert states == {"key": ("rule_flagged", "R1", 3), "k2": ("unassessed", "", 1)}
    run = f.runs.first()
    assert (run.phase_derived, run.phase2_readiness_pct, run.llm_assessed) == ("phase_0", None, False)


def test_representative_is_newest_then_smallest_hash(spark):
    rows = [alert(DAY1, 0, doc_hash="a", message="old"), alert(DAY1 + timedelta(hours=1), 1, doc_hash="c", message="c"),
            alert(DAY1 + timedelta(hours=1), 2, doc_hash="b", message="b")]
    assert analysis(spark, rows, []).representatives.first().message == "b"


def test_registry_problems(spark):
    doc = {"registry_version": "1", "teams": [
        {"team_id": "a", "display_name": "A", "v1_operators": ["x"], "v2_operator": "x"},
        {"team_id": "b", "display_name": "B", "v1_operators": ["x"], "v2_operator": None,
         "panels": [{"panel_id": "p", "schema": "v1", "sql": "", "variables": [
             {"name": "v", "type": "constant"}, {"name": "v", "type": "custom", "values": ["1"]}]}]},
        {"team_id": "c", "display_name": "C", "v1_operators": [], "v2_operator": None},
        {"team_id": "c", "display_name": "C", "v1_operators": ["z"], "v2_operator": None},
    ]}
    found = {(r.problem, r.subject) for r in registry_problems(registry_from_string(spark, json.dumps(doc))).collect()}
    assert found == {("operator_claimed_twice", "x"), ("duplicate_variable", "v"), ("variable_without_value", "v"),
                     ("no_operator", "c"), ("duplicate_team", "c")}
