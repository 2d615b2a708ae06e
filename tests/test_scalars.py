from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions import scalars as X
from sirenlens.functions import text as T
from sirenlens.functions.instants import parse_instant

SAMPLES = [
    None, "", "  ", "\t\n", "ok", " OK! ", " ok ", "I am alive.", "(( error   occurred ))",
    ". . ok", "n/a", " N/A ", "test-payments", "Unknown\x1c", "‘healthy’", "$ok", "ok+", "running…",
    "backup completed", "¿ok?", "high CPU.", "İok", "a\n b",
]


def py_field(v):
    return None if v is None else re.sub(r"\s+", " ", v.strip().lower())


def py_message(v):
    n = py_field(v)
    if n is None:
        return None
    punct = lambda ch: unicodedata.category(ch).startswith("P")
    while n and punct(n[0]):
        n = n[1:]
    while n and punct(n[-1]):
        n = n[:-1]
    return n.strip()


def test_text_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, v string")
    v = F.col("v")
    got = df.select(
        "i", T.normalize_field(v), T.normalize_message(v), T.is_blank(v), T.field_in(v, K.PLACEHOLDERS),
        T.message_in(v, K.HEARTBEAT_MESSAGES + K.GENERIC_MESSAGES),
    ).orderBy("i").collect()
    for row, s in zip(got, SAMPLES, strict=True):
        assert row[1] == py_field(s), repr(s)
        assert row[2] == py_message(s), repr(s)
        assert row[3] == (s is None or s.strip() == ""), repr(s)
        assert row[4] == (py_field(s) in K.PLACEHOLDERS), repr(s)
        assert row[5] == (py_message(s) in K.HEARTBEAT_MESSAGES + K.GENERIC_MESSAGES), repr(s)


STAMPS = [
    "2026-08-20T12:00:00.000Z", "2026-08-20T12:00:00", "2026-08-20 12:00:00.123456", "2026-08-20",
    "20260820T120000", "2026-08-20T12", "2026-08-20T12:30+02:00", "2026-W34-4", "2026W344", "2026-W34",
    "2026-08-20T12:00:00,5", "12:00", "2026-8-2", "2026-13-01", "2026-02-30", "", "x", "2026-08-20T25:00",
    "2026-08-20T12:00:00-0530", "2026-W54-1", "0000-01-01",
]


def py_parse(v):
    try:
        at = datetime.fromisoformat(v.replace("Z", "+00:00"))
    except ValueError:
        return None
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def test_instants_match_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(STAMPS)], "i int, v string")
    got = df.select("i", F.unix_micros(parse_instant(F.col("v")))).orderBy("i").collect()
    for row, s in zip(got, STAMPS, strict=True):
        want = py_parse(s)
        us = None if want is None else round(want.timestamp() * 1e6)
        assert row[1] == us, s


@pytest.mark.parametrize(
    ("url", "ok"),
    [("http:runbook", True), ("https:/x", True), ("https://u@h:80/p", True), ("https://:80", False),
     ("mailto:x@y", False), ("https://", False), ("//h", False), ("HTTP://H", True), (None, False)],
)
def test_urls(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(X.is_http_url(F.col("u"))).first()[0] is ok


def test_stable_hash_and_json_hash(spark):
    df = spark.createDataFrame(
        [('{"b":42.0,"a":"x"}', '{"a":"x","b":42}')], "l string, r string"
    )
    row = df.select(X.json_hash(F.col("l")) == X.json_hash(F.col("r")),
                    X.enc_object({"k": X.enc_text(F.lit("é")), "a": X.enc_int(F.lit(7))})).first()
    assert row[0] is True
    assert row[1] == "o2:s1:ad1:7s1:ks2:é"


def test_percent_and_half_up(spark):
    pairs = [(125, 1000, "13%"), (1, 1000, "<1%"), (996, 1000, "99%"), (5, 5, "100%"), (0, 5, "0%"), (3, 0, "0%")]
    df = spark.createDataFrame(pairs, "p long, w long, s string")
    assert all(r[0] == r[1] for r in df.select(X.percent(F.col("p"), F.col("w")), "s").collect())
    shown = spark.createDataFrame([(6.125,), (None,), (float("nan"),)], "v double").select(X.half_up(F.col("v"))).collect()
    assert [r[0] for r in shown] == ["6.13", "—", "—"]


def test_csv_cells(spark):
    from sirenlens.operators.facts import csv_text

    df = spark.createDataFrame([("=cmd", -1, None)], "a string, b int, c string")
    row = df.select(csv_text("a", "string"), csv_text("b", "int"), csv_text("c", "string")).first()
    assert tuple(row) == ("'=cmd", "'-1", "")
