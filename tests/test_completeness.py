"""Complete scans, stored sketches, bootstrap draws, kept answers, early pages, small sides."""

from __future__ import annotations

import hashlib
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sirenlens.operators import classify as L
from sirenlens.operators import completeness as Cp
from sirenlens.operators import evaluation as Ev
from sirenlens.operators import facts as W
from sirenlens.operators import published as P
from sirenlens.operators.attach import attach
from sirenlens.operators.window import RunSpec, runs_table, scope_alerts, span_of
from sirenlens.plans import sample
from sirenlens.plans.team_week import Analysis
from sirenlens.session import shared_dir
from tests.rows import alert, frame

END = datetime(2024, 1, 15, 18)


@pytest.fixture(scope="module")
def week(spark):
    rows = [
        alert(END - timedelta(hours=h, minutes=7), seq=h, operator=op, application=f"app-{h % 3}", key_field=f"k{h % 5}")
        for h in range(160) for op in ("op-a", "op-c")
    ]
    specs = [RunSpec(t, END) for t in ("team-a", "team-b")]
    return frame(spark, rows), sample.registry(spark), runs_table(spark, specs), span_of(specs)


def reported(week):
    alerts, reg, runs, _ = week
    return Cp.reported_totals(Cp.source_totals(alerts), reg.team_operators, runs)


def test_a_complete_scan_passes_and_a_short_one_is_refused(week):
    alerts, reg, runs, span = week
    totals = reported(week)
    assert {(r.alert_schema, r.reported_total) for r in totals.collect()} == {("v1", 160), ("v2", 0)}
    Analysis(alerts, reg, runs, span, cut=True, reported=totals).prefetch()
    for lost, named in (("seq = 9 and operator = 'op-c'", "159 of 160"), ("operator = 'op-a'", "0 of 160")):
        short = Analysis(alerts.where(f"not ({lost})"), reg, runs, span, cut=True, reported=totals)
        with pytest.raises(Cp.IncompleteScan, match=named):
            short.prefetch()
    twice = Analysis(alerts.union(alerts.where("seq = 3")), reg, runs, span, cut=True, reported=totals)
    with pytest.raises(Cp.IncompleteScan, match="161 of 160"):
        twice.prefetch()


def test_rows_of_the_wrong_run_are_no_complete_scan(week):
    alerts, reg, runs, span = week
    swapped = alerts.withColumn(
        "operator", F.when(F.col("seq") == 5, "op-c").when((F.col("seq") == 6), "op-c").otherwise(F.col("operator"))
    )
    scan = Cp.ObservedScan(scope_alerts(swapped, reg.team_operators, runs, span), reported(week))
    assert scan.rows.count() == 320  # the total alone would not tell
    with pytest.raises(Cp.IncompleteScan):
        scan.check()


def test_hours_are_not_divided(spark, week):
    alerts, reg, _, _ = week
    runs = runs_table(spark, [RunSpec("team-a", END + timedelta(minutes=30))])
    with pytest.raises(Exception, match="on the hour"):
        Cp.reported_totals(Cp.source_totals(alerts), reg.team_operators, runs).collect()


def test_files_are_counted_from_their_footers(spark):
    folder = f"{shared_dir(spark)}/footers-{uuid.uuid4().hex}"
    spark.range(0, 1000, 1, 4).write.parquet(folder)
    counts = Cp.footer_counts(spark, folder)
    assert sorted(r.rows for r in counts.collect()) == [250] * 4
    assert "ReadSchema: struct<>" in counts._jdf.queryExecution().toString()


def scored(spark, groups):
    rows = [(k, f"g{g}", h, h and r) for k, per in groups.items() for g, cases in enumerate(per) for h, r in cases]
    return spark.createDataFrame(rows, "trial string, group_key string, high_catalogue boolean, citation_correct boolean")


def test_bootstrap_draws_whole_groups(spark):
    rng = random.Random(4)
    per = [[(rng.random() < 0.6, rng.random() < 0.5) for _ in range(rng.randrange(1, 6))] for _ in range(9)]
    none = [[(False, False)], [(False, True)]]
    got = {r.trial: r for r in Ev.precision_interval(scored(spark, {"many": per, "one": per[:1], "none": none}), ["trial"], 300).collect()}
    order = sorted(range(9), key=lambda g: f"g{g}")
    found = []
    for s in range(1, 301):
        drawn = [order[int(hashlib.md5(f"{s}|{k}".encode()).hexdigest()[:8], 16) % 9] for k in range(9)]
        flags = [r for g in drawn for h, r in per[g] if h]
        if flags:
            found.append(sum(flags) / len(flags))
    found.sort()
    assert (got["many"].groups, got["many"].low, got["many"].high) == (
        9, pytest.approx(found[int((len(found) - 1) * 0.025)]), pytest.approx(found[int((len(found) - 1) * 0.975)]))
    assert (got["one"].groups, got["one"].low) == (1, None)
    assert (got["none"].groups, got["none"].low) == (2, None)


def test_a_task_that_runs_again_calls_once(spark):
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    log = f"{shared_dir(spark)}/calls-{uuid.uuid4().hex}".removeprefix("file:")

    def call(text, batch_id, attempt):
        with open(log, "a") as file:
            file.write(f"{batch_id}-{attempt}\n")
        if batch_id == "b3":
            raise L.ClassifierError("no answer", "timeout")
        return text.upper()

    todo = spark.createDataFrame([("r", f"b{k}", f"text {k}") for k in range(5)], "run_id string, batch_id string, request_text string")
    first = sorted(map(tuple, L.call_batches(todo, call, 1, folder=folder).collect()))
    again = sorted(map(tuple, L.call_batches(todo, call, 1, 3, folder=folder).collect()))
    assert first == again and [r[4] for r in first].count("timeout") == 1
    L.call_batches(todo.limit(1), call, 2, folder=folder).collect()
    with open(log) as file:
        assert sorted(file.read().split()) == sorted([f"b{k}-1" for k in range(5)] + ["b0-2"])


def test_early_pages_are_the_pages_of_the_whole_rank(spark, monkeypatch):
    rng = random.Random(8)
    rows = [
        (f"r{k % 3}", "v1", f"a{rng.randrange(9)}", f"k{k}", rng.choice(["rule_flagged", "assessed_good", "llm_flagged"]), rng.randrange(50), "", "")
        for k in range(400)
    ] + [("tiny", "v1", "a", "k", "rule_flagged", 1, "", "")]
    alerts = spark.createDataFrame(
        rows, "run_id string, alert_schema string, application string, key_field string, quality_state string, "
        "row_count long, core_rule_ids string, readiness_rule_ids string")
    for page in (0, 1, 3, 40):
        early = P.worklist_page(alerts, page, 10)
        assert "WindowGroupLimit" in early._jdf.queryExecution().toString()
        monkeypatch.setattr(P, "EARLY", 0)
        deep = P.worklist_page(alerts, page, 10)
        monkeypatch.setattr(P, "EARLY", 10_000)
        pick = ["run_id", "key_field", "rank", "page", "pages"]
        assert sorted(map(tuple, early.select(*pick).collect())) == sorted(map(tuple, deep.select(*pick).collect()))


def test_a_small_side_beyond_the_bound_is_salted(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    small = spark.createDataFrame([(0, "zero"), (1, "one")], "k long, name string")
    plain, salted = attach(rows, small, ["k"], ["id"]), attach(rows, small, ["k"], ["id"], most=1)
    assert "BroadcastHashJoin" in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, salted.select(plain.columns).collect()))


def test_digests_spare_equal_runs_and_tolerances(spark):
    make = lambda rows: spark.createDataFrame(rows, "`table` string, run_id string, item string, figure string, value double")
    same = [("days", "a", f"d{k}", "alerts", k / 3) for k in range(20)]
    expected = make(same + [("days", "b", "x", "alerts", 1.0), ("days", "b", "y", "alerts", 0.1234564), ("rules", "c", "z", "alerts", 2.0)])
    actual = make(same[::-1] + [("days", "b", "x", "alerts", 2.0), ("days", "b", "y", "alerts", 0.1234566), ("days", "d", "n", "alerts", None)])
    summary, bad = W.reconcile_by_digest(expected, actual, ["table", "run_id", "item"], ["table", "run_id"])
    assert sorted((r.run_id, r.item, r.status) for r in bad.collect()) == [("b", "x", "different"), ("c", "z", "missing"), ("d", "n", "unexpected")]
    assert {r.run_id: (r.expected_rows, r.found_rows, r.equal) for r in summary.collect()} == {
        "a": (20, 20, True), "b": (2, 2, False), "c": (1, 0, False), "d": (0, 1, False)}
