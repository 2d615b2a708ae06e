from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sirenlens.operators import episodes as E
from sirenlens.streaming.incremental import summarize_instants
from tests.rows import alert, every, frame

H = timedelta(hours=1)
D = datetime(2026, 8, 20)


def brute(points: list[tuple[datetime, bool]]) -> tuple:
    """(clears, max cycles in 24h, largest episode, open since) by walking the rows in order."""
    ordered = sorted(points)
    cycles, best_cycles, current, best, since = [], 0, 0, 0, None
    for i, (at, clear) in enumerate(ordered):
        if clear:
            if i and not ordered[i - 1][1]:
                cycles.append(at)
            current, since = 0, None
        else:
            since = at if current == 0 else since
            current += 1
            best = max(best, current)
    for i, at in enumerate(cycles):
        best_cycles = max(best_cycles, sum(1 for x in cycles[: i + 1] if at - x < timedelta(hours=24)))
    return sum(c for _, c in ordered), best_cycles, best, since


def facts(spark, rows, provider=None):
    df = frame(spark, rows).withColumn("run_id", F.lit("r"))
    found = E.firing_facts(df).withColumn("fire_pattern", E.fire_pattern(F.lit(provider) if provider else F.col("key_field")))
    return {r.key_field: r for r in found.collect()}


def test_random_histories_match_a_walk(spark):
    """Sparse, dense, tied and one very hot history, over many slices."""
    rng = random.Random(5)
    rows, expected = [], {}
    for k in range(120):
        n = 3000 if k == 0 else rng.randint(1, 40)
        grain = rng.choice([60, 600, 3600, 86400 // 4]) if k else 97
        points = [(D + timedelta(seconds=grain * rng.randint(0, 600_000 // grain)), rng.random() < rng.choice([0.1, 0.5, 0.9]))
                  for _ in range(n)]
        expected[f"k{k}"] = brute(points)
        rows += [alert(at, len(rows) + i, key_field=f"k{k}", severity="clear" if c else "error") for i, (at, c) in enumerate(points)]
    got = facts(spark, rows, "api")
    assert len(got) == 120
    for key, (clears, cycles, largest, since) in expected.items():
        r = got[key]
        opened = None if r.open_us is None else datetime(1970, 1, 1) + timedelta(microseconds=r.open_us)
        assert (r.clear_count, r.max_clear_cycles_24h, r.max_episode_firing_rows, opened) == (clears, cycles, largest, since), key


def fire(times, key, **more):
    return [alert(t, key_field=key, **more) for t in times]


CASES = [
    ("stuck-72h", every(D + 36 * H, 12 * H, 7), [], "grafana", "stuck"),
    ("open-71h59m", [*every(D + 36 * H + H / 60, 12 * H, 6), D + 108 * H], [], "grafana", None),
    ("ffc", [D + H, D + H * 1.1], [D + H * 1.2], "grafana", None),
    ("three-cycles", [D, D + 10 * H, D + 20 * H], [D + H / 12, D + 10 * H + H / 12, D + 20 * H + H / 12], "grafana", "flapping"),
    ("spread-26h", [D, D + 13 * H, D + 26 * H], [D + H / 12, D + 13 * H + H / 12, D + 26 * H + H / 12], "grafana", None),
    ("exactly-24h", [D, D + 12 * H, D + 24 * H], [D + H, D + 13 * H, D + 25 * H], "grafana", None),
    ("api-24-rows", [*every(D, H, 23), D + 24 * H], [], "api", "spamming"),
    ("api-23-rows", [*every(D, H, 22), D + 24 * H], [], "api", None),
    ("api-short", every(D, H / 6, 30), [], "api", None),
    ("api-100h", every(D, 25 * H, 5), [], "api", None),
    ("one-stale-row", [D], [], "grafana", None),
    ("no-provider-spams", [*every(D, H, 23), D + 24 * H], [], "none", "spamming"),
]


@pytest.mark.parametrize("provider", ["grafana", "api", "none"])
def test_patterns(spark, provider):
    chosen = [x for x in CASES if x[3] == provider]
    rows = []
    for key, fires, clears, _, _ in chosen:
        rows += fire(fires, key) + fire(clears, key, severity="clear")
    got = facts(spark, rows, provider)
    assert {k: r.fire_pattern for k, r in got.items()} == {x[0]: x[4] for x in chosen}


def test_v2_clears_by_status(spark):
    rows = [alert(D + i * H, i, alert_schema="v2", severity="clear", status="resolved" if i % 2 else "firing") for i in range(6)]
    r = facts(spark, rows, "api")["key"]
    assert (r.clear_count, r.max_clear_cycles_24h, r.fire_pattern) == (3, 3, "flapping")


def test_streamed_slice_summary_equals_the_scan(spark):
    rng = random.Random(9)
    rows = [alert(D + timedelta(seconds=rng.randint(0, 3599)), i, key_field=f"k{rng.randint(0, 9)}",
                  severity=rng.choice(["clear", "error"])) for i in range(400)]
    points = E.instants(frame(spark, rows).withColumn("run_id", F.lit("r")))
    scanned = {r.key_field: r for r in E.summarize_slices(E.scan_slices(points)).collect()}
    for key, want in scanned.items():
        mine = [(p.us, p.fires, p.clears) for p in points.where(F.col("key_field") == key).orderBy("us").collect()]
        got = summarize_instants(mine)
        got.pop("cycle_us")
        assert got == {n: want[n] for n in got}
