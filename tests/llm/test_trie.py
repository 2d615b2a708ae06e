"""The conversation trie against brute force: every band height, nulls, ties, repeats, empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sirenlens.llm import trie
from sirenlens.llm.common import prepared

TURNS = "conv_id long, turn long, role string, text string, depth int, k1 int, own int, piece int"


@pytest.fixture(scope="module")
def sp(spark):
    return prepared(spark)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [said for _, said in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        here = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        saved[node] = here + sum(saved[b] for b in below)
    return sorted(
        (
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node],
            saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, m in members.items()
    )


def turns(sp, rows):
    return sp.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], TURNS).repartition(6)


def found(sp, rows, band):
    return sorted(tuple(r) for r in trie.prefix_trie(turns(sp, rows), band).collect())


def conversations():
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 60), *range(95, 130), 100, 300, 317, 12345, 70_011]:
        long = rng.choice([1, 2, 4, 5, 8, 30])
        for turn in range(rng.randrange(long + 1)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["", "a", "ö", "hello", "x" * 9])))
    rows += [(5, None, "user", "first"), (5, None, None, None), (7, 2, "user", "tie"), (7, 2, "user", "tie")]
    rows += [(8, 3, None, "z"), (8, 3, "user", None), (None, 1, "user", "nobody"), (41, 0, "user", "w" * 100_000)]
    same = [(t, "user", f"same {t}") for t in range(20)]
    rows += [(c, *t) for c in range(1000, 1040) for t in same]
    rows += [(2000, t, "user", "again") for t in range(200)]
    return rows


@pytest.mark.parametrize("band", [2, 3, 32])
def test_trie(sp, band):
    rows = conversations()
    assert found(sp, rows, band) == brute(rows)


def test_turnless_conversations_are_at_the_root(sp):
    # c takes nothing from an absent conversation, and has no more turns than it gives up
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 1, "user", "gone")]
    assert found(sp, rows, 32) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_lists_of_endings(sp, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, t, "user", "hi") for c in range(100, 160) for t in range(3)]
    ends = trie.endings(
        sp.createDataFrame([(1, 2, 3, c, True) for c in range(60)] + [(1, 2, 4, 5, True), (1, 2, 4, 6, False)],
                           "depth long, k1 long, k2 long, conv_id long, last boolean").repartition(4)
    )
    want = {3: ",".join(map(str, range(60))), 4: "5"}
    assert {r.k2: r.ends_sha256 for r in ends.collect()} == {
        k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()
    }
    assert found(sp, rows, 32) == brute(rows)


def test_no_conversations(sp):
    assert found(sp, [], 32) == []
    assert found(sp, [(None, 1, "user", "x")], 32) == []
