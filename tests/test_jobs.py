from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sirenlens.operators import classify as L
from sirenlens.operators import facts as W
from sirenlens.operators import planning as Pl
from sirenlens.operators.ordered import with_running
from sirenlens.session import shared_dir
from tests.rows import T0


def test_running_sums_over_a_heavy_group(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randint(0, 9)) for i in range(2000)] + [(f"g{i % 7}", i, 1) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so that the group is cut, small as it is
    try:
        got = with_running(df, ["g"], [-F.col("i")], {"acc": "v"}).collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        acc = 0
        by_i = {r.i: r for r in got if r.g == g}
        for rank, (_, i, v) in enumerate(mine, 1):
            acc += v
            assert (by_i[i].rank, by_i[i].acc, by_i[i].group_size) == (rank, acc, len(mine))


def members_of(spark, n, groups=("u",)):
    rows = [("r", "v2", "app", f"k{i:04d}", g, "critical", "grafana", json.dumps({"a": 1, "k": i, "n": None}), "h", "1", "m")
            for g in groups for i in range(n)]
    return spark.createDataFrame(
        rows, "run_id string, alert_schema string, application string, key_field string, alert_rule_url string, "
        "severity string, provider string, document string, doc_hash string, prompt_version string, model_version string")


def test_balanced_batches(spark):
    placed = L.batch_members(members_of(spark, 401))
    sizes = [r.alert_count for r in L.batches(placed).orderBy("partition_index").collect()]
    assert sizes == [134, 134, 133]
    small = L.batches(L.batch_members(members_of(spark, 3, ("", "x")))).collect()
    assert sorted((r.group_type, r.alert_count) for r in small) == [("alert_rule_url", 3), ("application", 3)]


def test_request_is_factored_and_lossless(spark):
    placed = L.batch_members(members_of(spark, 3))
    table = L.batches(placed)
    members = L.with_batch_id(placed, table)
    request = json.loads(L.requests(members, table).first().request_text)
    assert request["shared_fields"] == {"a": 1, "n": None}
    assert [a["fields"] for a in request["alerts"]] == [{"k": 0}, {"k": 1}, {"k": 2}]
    assert L.lossless_violations(members, table).count() == 0


def _answer(request, principle="NONE", assessment="no_violation"):
    return json.dumps({"batch_id": request["batch_id"], "verdicts": [
        {"alert_id": a["alert_id"], "assessment": assessment, "principle_id": principle, "confidence": "high",
         "justification": "x"} for a in request["alerts"]]})


def test_three_attempts_then_the_whole_batch_fails(spark):
    placed = L.batch_members(members_of(spark, 2, ("ok", "late", "never", "wrong")))
    table = L.batches(placed)
    members = L.with_batch_id(placed, table)

    def call(text, batch_id, attempt):
        request = json.loads(text)
        group = request["group"]["value"]
        if group == "never" or (group == "late" and attempt < 3):
            raise L.ClassifierError("no answer", "timeout")
        # R7 never applies to a v2 alert
        return _answer(request, "R7", "catalog_violation") if group == "wrong" else _answer(request)

    verdicts, attempts, failed = L.assess(L.requests(members, table), members, call)
    assert verdicts.count() == 4
    log = {}
    groups = {r.batch_id: r.group_value for r in table.collect()}
    for r in attempts.orderBy("attempt_number").collect():
        log.setdefault(groups[r.batch_id], []).append(r.status)
    assert log == {"ok": ["succeeded"], "late": ["timeout", "timeout", "succeeded"], "never": ["timeout"] * 3,
                   "wrong": ["invalid_response"] * 3}
    lost = L.outcomes_of(verdicts, spark.createDataFrame([], verdicts.schema), failed, members).where("state = 'unassessed'")
    assert lost.count() == 4
    assert all(r.unassessed_reason.startswith("batch exhausted 3 attempts - ") for r in lost.collect())


def test_replace_runs_touches_only_its_runs(spark):
    path = f"{shared_dir(spark)}/sirenlens/test-{random.random()}"
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "run_id string, v int")
    W.replace_runs(old, path)
    W.replace_runs(spark.createDataFrame([("a", 9)], "run_id string, v int"), path)
    assert sorted((r.run_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
    published = spark.createDataFrame([("a", None)], "run_id string, withdrawn_at timestamp")
    with pytest.raises(ValueError, match="published"):
        W.replace_runs(old, path, published)


def test_csv_has_crlf_and_minimal_quotes(spark):
    from pathlib import Path

    path = f"{shared_dir(spark)}/sirenlens/csv-{random.random()}"
    df = spark.createDataFrame([('a,"b"', "plain", "")], "x string, y string, z string").coalesce(1)
    W.write_csv(df, path)
    text = next(Path(path.removeprefix("file:")).glob("*.csv")).read_bytes()
    assert text == b'x,y,z\r\n"a,""b""",plain,\r\n'


def test_invariants_report_the_offending_rows(spark):
    bad = spark.createDataFrame([("v1", 5, 3), ("v9", 1, 2)], "alert_schema string, distinct_count int, match_count int")
    assert sorted(r.rule for r in W.violations(bad, "daily_rule_counts").collect()) == ["distinct", "schema"]
    with pytest.raises(ValueError, match="breaks its rule"):
        W.require_valid(bad, "daily_rule_counts")


def test_reconciliation_tolerates_half_a_stored_unit(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, figure string, value double")
    expected = make([("x", "a", 1 / 24), ("x", "b", 1.0), ("x", "c", 1.0), ("x", "n", None)])
    actual = make([("x", "a", 0.041667), ("x", "b", 1.1), ("x", "d", 2.0), ("x", "n", None)])
    status = {r.figure: r.status for r in W.reconcile(expected, actual, ["k"]).collect()}
    assert status == {"a": "ok", "b": "different", "c": "missing", "d": "unexpected", "n": "ok"}


def test_week_plan(spark):
    now = datetime(2026, 8, 26, 9)
    monday = datetime(2026, 8, 24)
    latest = spark.createDataFrame(
        [("new", None), ("done", monday), ("two", monday - timedelta(days=14)), ("off", T0), ("old", monday - timedelta(days=98))],
        "team_id string, latest timestamp")
    plan = {}
    for r in Pl.plan_weeks(latest, now).orderBy("window_end").collect():
        plan.setdefault(r.team_id, []).append((r.plan, r.window_end))
    assert plan["new"] == [("due", monday)]
    assert "done" not in plan
    assert plan["two"] == [("due", monday - timedelta(days=7)), ("due", monday)]
    assert plan["off"] == [("blocked", None)]
    assert [p for p, _ in plan["old"]].count("expired") == 3
    due = {r.team_id: r.next_due for r in Pl.next_due(latest, now).collect()}
    assert due["done"] == monday + timedelta(days=7)


def test_week_outcomes_cascade(spark):
    now = datetime(2026, 8, 26)
    week = [datetime(2026, 8, 3) + timedelta(days=7 * i) for i in range(4)]
    health = spark.createDataFrame(
        [("a", week[0], False, None), ("a", week[1], False, "x"), ("a", week[2], False, None),
         ("b", week[0], False, "x"), ("b", week[1], True, None), ("b", week[2], False, "x"), ("b", week[3], False, None)],
        "team_id string, window_end timestamp, failed boolean, problems string")
    log = spark.createDataFrame(
        [("b", week[0], now - timedelta(days=4), "held"), ("b", week[2], now - timedelta(days=9), "held")],
        "team_id string, window_end timestamp, invoked_at timestamp, outcome string")
    got = [(r.team_id, r.outcome) for r in Pl.week_outcomes(health, log, now).orderBy("team_id", "window_end").collect()]
    assert got == [("a", "published"), ("a", "held"), ("a", "stored"), ("b", "published"), ("b", "failed"), ("b", "held"), ("b", "stored")]


def test_one_verdict_of_each_key_is_reused(spark):
    key = ("app", "k", "1", "m")
    names = "application string, key_field string, prompt_version string, model_version string"
    eligible = spark.createDataFrame([key, ("app", "other", "1", "m")], names)
    said = [(*key, "other", "OTHER", "low", "b"), (*key, "no_violation", "NONE", "high", "a")]
    verdicts = spark.createDataFrame(
        said, names + ", assessment string, principle_id string, confidence string, justification string")
    reused, remaining = L.reuse_verdicts(eligible, verdicts)
    assert [(r.key_field, r.assessment, r.justification) for r in reused.collect()] == [("k", "no_violation", "a")]
    assert [r.key_field for r in remaining.collect()] == ["other"]


def test_absent_keeps_the_first_new_row_by_value(spark):
    new = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("b", 5, None), ("b", 5, "y"), ("c", 0, "c")], "k string, v int, w string")
    stored = spark.createDataFrame([("c", 9, "kept")], "k string, v int, w string")
    for parts in (1, 5):
        got = W.absent(new.repartition(parts), stored, ["k"])
        assert sorted(map(tuple, got.collect())) == [("a", 1, "z"), ("b", 5, None)]


def test_requests_are_json_whatever_the_names(spark):
    odd = 'tab\t line\nquote" back\\slash \u0001 é'
    placed = L.batch_members(members_of(spark, 3, groups=(odd,)))
    table = L.batches(placed)
    request = L.requests(L.with_batch_id(placed, table), table).first()
    parsed = json.loads(request.request_text)
    assert parsed["group"]["value"] == odd and parsed["shared_fields"] == {"a": 1, "n": None}
    assert [a["fields"] for a in parsed["alerts"]] == [{"k": 0}, {"k": 1}, {"k": 2}]


def test_calls_are_dealt_to_several_tasks(spark):
    import os

    rows = [("r", f"b{k}", "text") for k in range(64)]
    todo = spark.createDataFrame(rows, "run_id string, batch_id string, request_text string").coalesce(1)
    called = L.call_batches(todo, lambda text, batch, attempt: f"{os.getpid()}", 1)
    assert called.count() == 64
    assert called.select(F.spark_partition_id()).distinct().count() > 1
