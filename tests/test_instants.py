"""Instants in rare forms: what they are, and that a text is matched once for each of its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sirenlens.functions.instants import parse_instant

TEXTS = {
    "20240115T101112": "2024-01-15 10:11:12", "2024-01-15T10:11:12,5Z": "2024-01-15 10:11:12.5",
    "2024-W03-1": "2024-01-15 00:00:00", "2024W031T10": "2024-01-15 10:00:00",
    "20240115T1011+0230": "2024-01-15 07:41:00", "2024-01-15x10:11-02": "2024-01-15 12:11:00",
    "2024-W60-1": None, "00000115": None, "10:11": None, "2024-1-5": None, "Z": None, "": None,
}


def test_rare_forms(spark):
    rows = spark.createDataFrame([*[(t,) for t in TEXTS], (None,)], "t string")
    got = {r.t: r.at for r in rows.select("t", F.try_to_timestamp(parse_instant(F.col("t")).cast("string")).cast("string").alias("at")).collect()}
    assert got == {**TEXTS, None: None}


def test_each_part_is_taken_out_once(spark):
    rows = spark.createDataFrame([("20240115",)], "t string").select(parse_instant(F.col("t")).alias("at"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # date, time and zone of the text, its digits (three times) and its fraction
    assert plan.count("regexp_extract(") <= 7
