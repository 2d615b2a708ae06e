"""Rows meet their owners, and a stream's batches their facts, without a shuffle of the rows."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from sirenlens.operators import suppression as V
from sirenlens.operators.attach import attach
from sirenlens.operators.window import RunSpec, runs_table, scope_alerts, span_of
from sirenlens.session import shared_dir
from sirenlens.sources.registry import registry_from_string
from sirenlens.streaming import incremental as S
from tests.rows import T0, alert, frame

REGISTRY = '{"registry_version":"1","teams":[{"team_id":"t","v1_operators":["op"],"v2_operator":null,"panels":[]}]}'
SPECS = [RunSpec("t", T0 + timedelta(hours=h)) for h in (1, 100)]


def alerts(spark, n=12):
    rows = [alert(T0 - timedelta(minutes=k), k, key_field=f"k{k % 3}", operator="op" if k % 4 else "other") for k in range(n)]
    return frame(spark, rows)


def test_rows_are_not_shuffled_by_their_operator(spark):
    reg, runs = registry_from_string(spark, REGISTRY), runs_table(spark, SPECS)
    owned = scope_alerts(alerts(spark), reg.team_operators, runs, span_of(SPECS))
    plan = owned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    assert "BroadcastHashJoin [alert_schema" in plan
    assert owned.count() == 2 * 9  # both windows hold every owned row


def test_a_side_too_large_to_broadcast_may_repeat_its_keys(spark):
    small = spark.createDataFrame([("op", k) for k in range(3)] + [("nobody", 9)], "operator string, run int")
    rows = alerts(spark)
    wanted = rows.join(small, "operator")
    got = attach(rows, small, ["operator"], ["key_field", "ts"], "inner", most=0)
    assert got.columns == wanted.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_a_batch_is_scoped_and_read_twice(spark):
    """Once to judge every row, once to fetch those that are shown; the counts read what was written."""
    reg, runs = registry_from_string(spark, REGISTRY), runs_table(spark, SPECS)
    folder = f"{shared_dir(spark)}/scoping-{uuid.uuid4().hex}"
    alerts(spark).write.parquet(f"{folder}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    def scope(batch):
        read = batch.mapInPandas(counted, batch.schema)
        return scope_alerts(read, reg.team_operators, runs, span_of(SPECS))

    plans = V.panel_plans(reg, V.number_leaves(V.interpret_leaves(reg)))
    stream = S.read_stream(spark, f"{folder}/in", alerts(spark).schema)
    S.ingest(stream, scope, plans, f"{folder}/facts", 86_400_000_000)
    assert S.merged_signatures(spark, f"{folder}/facts").agg(F.sum("n")).first()[0] == 2 * 9
    assert seen.value == 2 * 12
