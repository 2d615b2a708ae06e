"""Near vectors in several files: brute force, copies, pairs at the limit, and the disk that is used."""

from __future__ import annotations

import os

import numpy as np
import pytest

from sirenlens.llm import vectors
from sirenlens.llm.common import prepared
from sirenlens.session import shared_dir

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def sp(spark):
    return prepared(spark)


def size(folder):
    return sum(os.path.getsize(os.path.join(d, name)) for d, _, names in os.walk(folder) for name in names)


def test_disk_follows_the_input(sp, monkeypatch):
    """Every vector is in one file, whatever the number of vectors of its label."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    x[1000:1300] = x[0] + rng.standard_normal((300, 64)) * 0.15  # a large group
    x[2000:2400] = x[2400:2800] + rng.standard_normal((400, 64)) * rng.uniform(0.2, 0.6, (400, 1))
    x[3000:3010] = x[5]  # copies
    x = x.astype(np.float32)
    rows = sp.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], SCHEMA).repartition(8)
    monkeypatch.setattr(vectors, "SIDE", 500)
    folder = shared_dir(sp).removeprefix("file:")
    before = size(folder)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(rows).collect()}
    assert size(folder) - before < 3 * x.nbytes
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert got == dict(enumerate(((u @ u.T >= 0.93).sum(axis=1) - 1).tolist()))


def test_pairs_at_the_limit_are_judged_by_their_values(sp, monkeypatch):
    """Cosines of 0.93 and next to it, with values that float32 does not hold."""
    rng = np.random.default_rng(6)
    x = []
    for k in range(60):
        a, b = np.linalg.qr(rng.standard_normal((24, 2)))[0].T
        c = 0.93 + (k - 30) * 1e-9
        x += [a, (c * a + np.sqrt(1 - c * c) * b) * 3]
    monkeypatch.setattr(vectors, "SIDE", 40)
    rows = sp.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], SCHEMA.replace("float", "double"))
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(rows).collect()}
    linked = [int(x[k] @ x[k + 1] / np.sqrt((x[k] @ x[k]) * (x[k + 1] @ x[k + 1])) >= 0.93) for k in range(0, 120, 2)]
    assert 20 < sum(linked) < 40
    assert got == {k: linked[k // 2] for k in range(120) if k // 2 != 30} | {k: got[k] for k in (60, 61)}


def test_rounding_keeps_every_pair_within_a_budget():
    rng = np.random.default_rng(8)
    for dim in (2, 16, 40, 64, 300):
        a = rng.standard_normal((2000, dim))
        b = a + rng.standard_normal((2000, dim)) * 0.27 * rng.uniform(0.9, 1.1, (2000, 1))
        a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
        near = np.einsum("ij,ij->i", a, b) >= 0.93
        assert near.any()
        a, b = (np.rint(v[near] @ vectors.rotation(dim) * vectors.SCALE) for v in (a, b))
        within = [((a[:, s:e] - b[:, s:e]) ** 2).sum(axis=1) <= r for (s, e), r in zip(vectors.blocks_of(dim), vectors.budgets(dim, 0.93), strict=True)]
        assert np.any(within, axis=0).all()
