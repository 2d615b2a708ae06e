"""Whitening: exact sums, polynomials and roots against brute force, nulls, ties, degenerate tables."""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pytest

from sirenlens.llm import whitening
from sirenlens.llm.common import prepared

ROWS = "vec_id long, embedding array<float>, y array<int>, n int, component int"


@pytest.fixture(scope="module")
def sp(spark):
    return prepared(spark)


def table(sp, vectors, kind="float"):
    rows = [(k, v, [1], 2, 3) for k, v in enumerate(vectors)]
    return sp.createDataFrame(rows, ROWS.replace("float", kind))


def brute(vectors):
    """Covariance of the distinct integer vectors in fractions, and its eigenvectors in doubles."""
    x = sorted({tuple(int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    values, found = np.linalg.eigh(np.array(cov, float))
    return n, sums, cov, values[::-1], found[:, ::-1]


def test_sums_are_exact(sp):
    rng = np.random.default_rng(1)
    y = rng.integers(-(1 << 62), 1 << 62, (5000, 3))
    y[:10] = 5
    got = whitening.gram(y)
    rows = [[int(v) for v in r] for r in y]
    assert got.tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]
    fit = sp.createDataFrame([(r,) for r in rows], "y array<long>").repartition(3)
    n, sums, scatter = whitening.scatter_of(fit, 3)
    assert (n, sums) == (5000, [sum(r[i] for r in rows) for i in range(3)])
    assert scatter == [[n * int(got[i, j]) - sums[i] * sums[j] for j in range(3)] for i in range(3)]


def exact_polynomial(matrix):
    """Faddeev and LeVerrier's recursion."""
    d = len(matrix)
    a, m, out = np.array(matrix, object), np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + np.eye(d, dtype=int).astype(object) * out[-1]
        out.append(-sum(a.dot(m)[i, i] for i in range(d)) // k)
    return out[::-1]


@pytest.mark.parametrize("d", [1, 2, 3, 9, 20])
def test_polynomial_and_roots(sp, d):
    rng = np.random.default_rng(d)
    x = rng.integers(-(10**9), 10**9, (d + 2, d)).astype(object)
    x[:, 0] = 0  # a root at zero
    matrix = x.T.dot(x).tolist()
    coefficients = whitening.characteristic_polynomial(sp, matrix)
    assert coefficients == exact_polynomial(matrix)
    values = np.linalg.eigvalsh(np.array(matrix, float))[::-1][: d - 1]
    got = whitening.largest_roots(coefficients, d)
    assert sum(m for _, _, m in got) == d - 1
    assert np.allclose([p / (1 << s) for p, s, _ in got], values, rtol=1e-9)


def test_equal_and_close_roots(sp):
    # roots 5, 5, 3 and 3 + 2**-80, scaled to integers
    roots = [5 << 80, 5 << 80, 3 << 80, (3 << 80) + 1, 0]
    coefficients = [1]
    for r in roots:
        coefficients = [a - r * b for a, b in zip([0, *coefficients], [*coefficients, 0], strict=True)]
    got = whitening.largest_roots(coefficients, 4)
    assert [m for _, _, m in got] == [2, 1, 1]
    exact = [5 << 80, (3 << 80) + 1, 3 << 80]
    assert all(abs(Fraction(p, 1 << s) - r) < Fraction(1, 1 << 120) for (p, s, _), r in zip(got, exact, strict=True))
    assert whitening.largest_roots(coefficients, 1) == got[:1]


def test_components_of_roots_that_doubles_cannot_tell_apart():
    # eigenvalues differ by one part in 10**20; the eigenvectors are (3, 4)/5 and (-4, 3)/5
    big, step = 25 * 10**20, 25
    matrix = [[big + 9 * step // 25, 12 * step // 25], [12 * step // 25, big + 16 * step // 25]]
    with localcontext() as context:
        context.prec = whitening.DIGITS
        one = whitening.null_space(matrix, Decimal(big + step), 1)[0]
        other = whitening.null_space(matrix, Decimal(big), 1)[0]
        both = whitening.null_space([[7, 0], [0, 7]], Decimal(7), 2)
    assert np.allclose(np.abs(np.array(one, float)), [0.6, 0.8], atol=1e-16)
    assert np.allclose(np.abs(np.array(other, float)), [0.8, 0.6], atol=1e-16)
    assert abs(float(both[0].dot(both[1]))) < 1e-30


@pytest.mark.parametrize("d", [3, 20])
def test_whitening_against_brute_force(sp, d):
    rng = np.random.default_rng(d)
    vectors = [np.float32(v).tolist() for v in rng.normal(size=(150, d)) @ rng.normal(size=(d, d))]
    vectors += vectors[:3] + [vectors[5]] * 200  # repeated rows
    odd = [None, [], [None] * d, [1.0] * (d - 1), [float("nan")] * d, [*[0.0] * (d - 1), float("-inf")]]
    docs = table(sp, vectors + odd).repartition(4)
    n, sums, cov, values, found = brute(vectors)
    got = whitening.whiten(docs).collect()
    kept = min(16, d)
    assert len(got) == kept * len(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    trace = float(sum(cov[i][i] for i in range(d)))
    sign = {}
    for k, v in enumerate(vectors):
        x = [int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v]
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        for c in range(kept):
            r = by[k, c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(values[c] / trace, rel=1e-10)
            assert r.identity_error < 1e-9
            want = centred @ found[:, c] / np.sqrt(values[c])
            sign.setdefault(c, np.sign(want) * np.sign(r.whitened))
            assert r.whitened * sign[c] == pytest.approx(want, abs=1e-7)


def test_tables_without_spread(sp):
    assert whitening.whiten(table(sp, [])).collect() == []
    assert whitening.whiten(table(sp, [None, [None]])).collect() == []
    one = whitening.whiten(table(sp, [[0.5, 1.0], [0.5, 1.0]])).collect()
    assert sorted((r.vec_id, r.component) for r in one) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, None)}
    line = whitening.whiten(table(sp, [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]])).collect()
    first = [r for r in line if r.component == 1]
    assert all(r.explained == pytest.approx(1) and r.identity_error < 1e-12 for r in first)
    assert sorted(round(abs(r.whitened), 9) for r in first) == [0, pytest.approx(1.5**0.5), pytest.approx(1.5**0.5)]
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component == 2)


def test_very_large_entries(sp):
    vectors = [[1e15, 0.0], [-1e15, 3.0], [0.0, -2.0], [1e300, 1.0]]
    got = whitening.whiten(table(sp, vectors, "double")).collect()
    assert {r.vec_id for r in got} == {0, 1, 2}
    assert all(r.identity_error < 1e-9 for r in got)
    x = [64 * 10**15, -64 * 10**15, 0]
    y = [0, 192, -128]
    want = {k: (3 * x[k] - sum(x)) ** 2 + (3 * y[k] - sum(y)) ** 2 for k in range(3)}
    assert {r.vec_id: r.deviation for r in got} == want
