"""The log of partial facts: merges, replays, manifests, and what they leave on disk."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyarrow import fs

from sirenlens.session import shared_dir
from sirenlens.streaming import incremental as S

T = datetime(2024, 1, 10)
ID = "run_id string, alert_schema string, application string, key_field string"


@pytest.fixture
def log(spark, monkeypatch):
    monkeypatch.setattr(S, "MERGE", {k: S.MERGE[k] for k in ("newest", "first_findings")})
    return S.Log(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}")


def tables(spark, k):
    """Batch k: identity a is seen again and again, another one only once; a finding whose first row is in batch 2."""
    at = T + timedelta(hours=k)
    newest = [("t", "r", "v1", "x", "a", at), ("t", "r", "v1", "x", f"only-{k}", at)]
    first_ts = T if k == 2 else at
    first = [("r", "v1", "x", "a", "R1", k + 1, first_ts, k - 5)]
    shown = [("r", "v1", "x", "a", at, k, f"newest {k}"), ("r", "v1", "x", "a", first_ts, k - 5, f"first {k}"), ("r", "v1", "x", f"only-{k}", at, k, "once")]
    make = spark.createDataFrame
    return {
        "newest": make(newest, f"team_id string, {ID}, ts timestamp"),
        "first_findings": make(first, f"{ID}, rule_id string, matched_rows long, first_ts timestamp, first_seq long"),
        "shown": make(shown, f"{ID}, ts timestamp, seq long, text string"),
    }


def runs_on_disk(log):
    system, path = fs.FileSystem.from_uri(f"{log.folder}/runs")
    return {f.base_name for f in system.get_file_info(fs.FileSelector(path))}


def test_runs_are_merged_level_by_level(spark, log, monkeypatch):
    monkeypatch.setattr(S, "FAN", 2)
    assert log.manifest() == []
    for k in range(7):
        log.write(f"batch-{k}", tables(spark, k))
        log.add(k, f"batch-{k}")
        if k == 4:  # the batch comes again, after its manifest was committed
            before = log.manifest()
            log.write("batch-4", tables(spark, 4))
            log.add(4, "batch-4")
            assert log.manifest() == before
    live = log.manifest()
    levels = [level for _, level in live]
    assert len(levels) == len(set(levels)) == 3  # 7 = 4 + 2 + 1
    newest = {r.key_field: r.ts for r in log.read("newest").collect()}
    assert newest == {"a": T + timedelta(hours=6), **{f"only-{k}": T + timedelta(hours=k) for k in range(7)}}
    (first,) = log.read("first_findings").collect()
    assert (first.matched_rows, first.first_ts, first.first_seq) == (sum(range(1, 8)), T, -5)
    shown = sorted((r.key_field, r.text) for r in log.read("shown").collect() if r.key_field == "a")
    # batch 0's rows stand at the instant of the first one of all; the others went when runs were merged
    assert [x for x in shown if x[1] not in ("first 6", "first 5")] == [
        ("a", "first 0"), ("a", "first 2"), ("a", "newest 0"), ("a", "newest 6")]
    # what only manifests before the last one named is gone
    kept = {r for r, _ in live} | {r for r, _ in log.manifest(below=6)}
    assert runs_on_disk(log) <= kept


def test_an_uncommitted_run_does_not_count(spark, log):
    log.write("batch-0", tables(spark, 0))
    log.add(0, "batch-0")
    log.write("batch-1", tables(spark, 1))  # and then the job fails
    assert log.manifest() == [("batch-0", 0)]
    assert log.read("newest").count() == 2
