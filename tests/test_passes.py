"""What the passes over the rows make anew, and for how many rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from sirenlens.operators import episodes as E
from sirenlens.operators import rowfacts as R
from sirenlens.operators.identity import ID
from sirenlens.session import materialize
from tests.rows import T0, alert, frame


def test_hashes_are_made_for_shown_rows_only(spark):
    hashed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def document_hash(seq):
        hashed.add(1)
        return f"h{seq}"

    source = frame(spark, [alert(T0 + timedelta(minutes=i), i) for i in range(50)])
    made = source.withColumn("doc_hash", document_hash("seq"))
    runs = spark.createDataFrame([("t", "r", "op")], "team_id string, run_id string, operator string")
    scoped = made.join(F.broadcast(runs), "operator")
    rows = scoped.select("team_id", *ID, "ts", "seq")
    last = materialize(R.newest(rows), "newest")
    first = materialize(rows.where("seq = 7").select(*ID, F.col("ts").alias("first_ts")), "first-findings")
    hashed.value = 0
    shown = R.shown_rows(scoped, last, first).select("seq", "doc_hash").collect()
    assert sorted(shown) == [(7, "h7"), (49, "h49")]
    assert hashed.value == 2


def test_instants_are_scanned_once(spark):
    rows = [alert(T0 + timedelta(minutes=17 * i), i, key_field=f"k{i % 3}", severity="error" if i % 4 else "clear")
            for i in range(200)]
    points = E.instants(frame(spark, rows).withColumn("run_id", F.lit("r")))
    facts = E.firing_of_instants(points, keep=materialize)
    assert {path.split("/")[-2].split("-")[0] for path in facts.inputFiles()} == {"scanned", "slices"}
    assert sorted(facts.collect()) == sorted(E.firing_of_instants(points).collect())
