"""Embedding whitening by an exact characteristic polynomial.

Entries become integers, so the scatter of all distinct vectors is an integer matrix and is summed without
rounding. Its characteristic polynomial comes from Hessenberg reductions modulo primes, dealt to tasks,
and Chinese remaindering. All its roots are real, so Descartes' rule counts the roots above any point
exactly; bisection isolates the largest ones and refines them to ``BITS`` bits. A component is the null
space of the scatter less its root, by inverse iteration with ``DIGITS`` digits. Only matrices of the
vectors' dimension pass through the driver.

A row whose vector is null or empty, or holds a null, a non-finite entry, or one of 2**56 and more (no
long holds it), is dropped; so is one whose length is not that of most rows (ties: the longer). Equal
vectors count once in the fit, and all rows get their results; null ids are kept. Further columns are
ignored. Without rows the result is empty. With fewer dimensions than components there are as many
components as dimensions; one of variance 0 has null whitened values and explains 0. Of components
with one variance any orthonormal basis is right; the same is chosen in every run.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import shuffle_partitions
from sirenlens.session import materialize

COMPONENTS = 16
#: An entry's integer is ``floor(SCALE * entry)``; a constant added to it changes no covariance.
SCALE = 64
#: Largest magnitude of an entry.
LARGEST = float(1 << 56)
#: Bits of a root, relative to the trace, and digits in which components are computed.
BITS, DIGITS = 220, 120

#: Rows of an exact product in doubles: 20-bit limbs give 2**40 * 2**12.
_LIMB, _ROWS = 20, 4096
_WORD = 32
_SUMS = "pos int, limb int, value long"
_POLYNOMIAL = "prime long, coefficients array<long>"
_VECTOR = "number int, vector array<double>, scale double"
_ENTRY = "pos int, value double"
_RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


# -- integers ---------------------------------------------------------------------------------


def points(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, y`` of the rows that count; ``y`` is the integer vector."""
    entries = F.transform(F.col(vector), lambda v: v.cast("double"))
    good = F.forall(entries, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST)))
    rows = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    rows = rows.where(F.coalesce(good, F.lit(False)))
    y = F.transform(entries, lambda v: F.floor(v * F.lit(float(SCALE))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), y.cast("array<long>").alias("y"))


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64, copy=False).reshape(len(column), dims)


def gram(y: np.ndarray) -> np.ndarray:
    """The exact sum of outer products, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for first in range(0, len(y), _ROWS):
        rest, limbs = y[first : first + _ROWS], []
        while np.abs(rest).max(initial=0) >= 1 << _LIMB:
            limbs.append((rest & ((1 << _LIMB) - 1)).astype(np.float64))
            rest = rest >> _LIMB
        limbs.append(rest.astype(np.float64))
        for i, one in enumerate(limbs):
            for j, two in enumerate(limbs):
                part = (one.T @ two).astype(np.int64)
                total += part.astype(object) * (1 << _LIMB * (i + j))
    return total


def _moments(dims: int):
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            y = matrix_of(batch["y"], dims)
            n += len(y)
            for first in range(0, len(y), 1 << 16):  # halves, so that no sum leaves 64 bits
                part = y[first : first + (1 << 16)]
                sums += (part >> _WORD).sum(axis=0).astype(object) * (1 << _WORD)
                sums += (part & ((1 << _WORD) - 1)).sum(axis=0).astype(object)
            products += gram(y)
        entries = [(0, n), *enumerate(sums, 1), *enumerate(products[upper], 1 + dims)]
        rows = []
        for pos, value in entries:
            sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
            while rest:
                rows.append((pos, limb, sign * (rest & ((1 << _WORD) - 1))))
                rest, limb = rest >> _WORD, limb + 1
        columns = list(zip(*rows, strict=True)) or [()] * 3
        kinds = (pa.int32(), pa.int32(), pa.int64())
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pos", "limb", "value"]
        )

    return run


def scatter_of(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums of ``fit(y)`` and ``n * sum(y y') - (sum y)(sum y)'``, all exact.

    Tasks send 32-bit limbs, whose sums over tasks fit a long.
    """
    found = fit.mapInArrow(_moments(dims), _SUMS).groupBy("pos", "limb").agg(F.sum("value").alias("value"))
    values = [0] * (1 + dims + dims * (dims + 1) // 2)
    for pos, limb, value in found.collect():  # a few for each entry of the matrix
        values[pos] += value << (_WORD * limb)
    n, sums = values[0], values[1 : 1 + dims]
    scatter = [[0] * dims for _ in range(dims)]
    rest = iter(values[1 + dims :])
    for i in range(dims):
        for j in range(i, dims):
            scatter[i][j] = scatter[j][i] = n * next(rest) - sums[i] * sums[j]
    return n, sums, scatter


# -- the polynomial ---------------------------------------------------------------------------


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of ``det(x - matrix)`` modulo the prime ``p`` < 2**31, the constant first."""
    h, d = matrix.copy(), len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        r = k + int(below[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks, by size
    leading[0, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = leading[m - 1, :-1]
        weights, product = np.zeros(m, np.int64), 1
        weights[m - 1] = h[m - 1, m - 1]
        for i in range(m - 2, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            weights[i] = int(h[i, m - 1]) * product % p
        leading[m] = (new - (weights[:, None] * leading[:m] % p).sum(axis=0)) % p
    return leading[d].tolist()


def primes_for(bound: int) -> list[int]:
    """Primes below 2**31, from the top, whose product exceeds ``bound``."""
    small = np.ones(46342, bool)
    small[:2] = False
    for k in range(2, 216):
        if small[k]:
            small[k * k :: k] = False
    divisors = np.flatnonzero(small)
    out, product, candidate = [], 1, (1 << 31) - 1
    while product <= bound:
        if (candidate % divisors).all():
            out.append(candidate)
            product *= candidate
        candidate -= 2
    return out


def characteristic_polynomial(spark, scatter: list[list[int]]) -> list[int]:
    """Coefficients of ``det(x - scatter)``, the constant first, for a positive semidefinite matrix.

    The k-th elementary symmetric function of roots that are not negative is at most
    ``C(d, k) (trace / d)**k``, which says how many primes are enough.
    """
    d = len(scatter)
    mean = sum(scatter[i][i] for i in range(d)) // d + 1
    primes = primes_for(2 * max(math.comb(d, k) * mean**k for k in range(d + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [primes[k] for k in batch["id"].to_pylist()]
            found = [
                polynomial_modulo(np.array([[v % p for v in row] for row in scatter], np.int64), p) for p in mine
            ]
            yield pa.record_batch(
                [pa.array(mine, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["prime", "coefficients"],
            )

    tasks = min(len(primes), shuffle_partitions(spark))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, _POLYNOMIAL).collect()
    product = math.prod(primes)
    total = [0] * (d + 1)
    for prime, coefficients in rows:
        rest = product // prime
        weight = rest * pow(rest, -1, prime)
        total = [(t + c * weight) % product for t, c in zip(total, coefficients, strict=True)]
    return [t - product if 2 * t > product else t for t in total]


# -- its roots --------------------------------------------------------------------------------


def roots_above(coefficients: list[int], point: int, shift: int) -> int:
    """How many roots, with multiplicity, exceed ``point / 2**shift``.

    For a polynomial whose roots are all real, the sign changes of its coefficients about a point
    are exactly the roots beyond it.
    """
    d = len(coefficients) - 1
    c = [v << shift * (d - k) for k, v in enumerate(coefficients)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(coefficients: list[int], point: int, shift: int) -> int:
    """The sign at ``point / 2**shift``."""
    value, d = 0, len(coefficients) - 1
    for k in range(d, -1, -1):
        value = value * point + (coefficients[k] << shift * (d - k))
    return (value > 0) - (value < 0)


def largest_roots(coefficients: list[int], most: int) -> list[tuple[int, int, int]]:
    """``(point, shift, multiplicity)`` of the largest positive roots, ``point / 2**shift`` each.

    Enough for ``most`` roots. Roots closer than ``2**-BITS`` of the trace count as one.
    """
    coefficients = coefficients[next(k for k, v in enumerate(coefficients) if v) :]  # roots at zero go
    if len(coefficients) == 1:
        return []
    top = max(0, -coefficients[-2]).bit_length()  # no root exceeds the trace
    fine = max(0, BITS - top)
    found: list[tuple[int, int, int]] = []
    # intervals (low, high] in units of 2**-shift, with the roots above both ends, largest last
    open_ = [(0, 1 << top, 0, roots_above(coefficients, 0, 0), 0)]
    while open_:
        low, high, shift, above_low, above_high = open_.pop()
        if above_low == above_high or above_high >= most:
            continue
        if above_low - above_high == 1:
            found.append((*_refined(coefficients, low, high, shift, fine), 1))
            continue
        if high - low == 1:
            if shift >= fine:
                found.append((2 * low + 1, shift + 1, above_low - above_high))
                continue
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        between = roots_above(coefficients, middle, shift)
        open_.append((low, middle, shift, above_low, between))
        open_.append((middle, high, shift, between, above_high))
    return found


def _refined(coefficients: list[int], low: int, high: int, shift: int, fine: int) -> tuple[int, int]:
    """The only root in ``(low, high]``."""
    at_top = _sign(coefficients, high, shift)
    if not at_top:
        return high, shift
    while True:
        if high - low == 1:
            if shift >= fine:
                return 2 * low + 1, shift + 1
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        sign = _sign(coefficients, middle, shift)
        if not sign:
            return middle, shift
        low, high = (low, middle) if sign == at_top else (middle, high)


# -- the components ---------------------------------------------------------------------------


def null_space(scatter: list[list[int]], root: Decimal, many: int) -> list[np.ndarray]:
    """``many`` orthonormal eigenvectors of ``scatter`` at ``root``, by inverse iteration in decimals."""
    d = len(scatter)
    trace = Decimal(sum(scatter[i][i] for i in range(d)))
    least = trace.scaleb(-(DIGITS - 20))
    a = np.array([[Decimal(v) for v in row] for row in scatter], object)
    for i in range(d):
        a[i, i] -= root
    order = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        if abs(a[k, k]) < least:
            a[k, k] = least
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for i in range(1, d):
            x[i] -= a[i, :i].dot(x[:i])
        for i in range(d - 1, -1, -1):
            if i + 1 < d:
                x[i] -= a[i, i + 1 :].dot(x[i + 1 :])
            x[i] /= a[i, i]
        return x

    def orthonormal(vectors: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for v in vectors:
            for _ in range(2):
                for u in out:
                    v = v - u * u.dot(v)
                v = v / v.dot(v).sqrt()
            out.append(v)
        return out

    seeds = [[hashlib.sha256(f"{k} {i}".encode()).digest()[:6] for i in range(d)] for k in range(many)]
    vectors = orthonormal(
        [np.array([Decimal(int.from_bytes(b) - (1 << 47)) for b in row], object) for row in seeds]
    )
    for _ in range(3):  # each step gains the distance to the next root over the root's error
        vectors = orthonormal([solved(v) for v in vectors])
    return vectors


def _as_double(v: np.ndarray) -> np.ndarray:
    """The unit vector in doubles, its largest entry positive."""
    k = max(range(len(v)), key=lambda i: (abs(v[i]), -i))
    return np.array([float(x if v[k] > 0 else -x) for x in v])


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` distinct vectors with sums ``sums``; components in rows, largest variance first.

    ``deviations`` are the square roots of the variances, ``explained`` their shares of the trace.
    """

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray = field(repr=False)
    deviations: np.ndarray
    explained: np.ndarray

    def centred(self, y: np.ndarray) -> np.ndarray:
        """``n * y - sums``, exact: longs where they are wide enough, else Python integers."""
        fits = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums)) < 1 << 63
        return y * np.array(self.n if fits else [self.n], y.dtype if fits else object) - np.array(
            self.sums, np.int64 if fits else object
        )

    def project(self, centred: np.ndarray) -> np.ndarray:
        """A row's result depends on that row alone, to the last bit."""
        exact = (centred / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.einsum("ij,kj->ik", exact, self.components) / self.deviations


def squares(centred: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exact; null where 38 digits are too few."""
    if centred.dtype != object and len(centred) and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
        return pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
    found = (centred.astype(object) ** 2).sum(axis=1) if len(centred) else []
    return pa.array([Decimal(v) if v < 10**38 else None for v in found], pa.decimal128(38, 0))


def fit_whitening(spark, fit: DataFrame, dims: int, most: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors ``fit(y)`` of ``dims`` entries."""
    n, sums, scatter = scatter_of(fit, dims)
    trace = sum(scatter[i][i] for i in range(dims))
    roots = largest_roots(characteristic_polynomial(spark, scatter), most) if trace else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch["id"].to_pylist():
                point, shift, many = roots[k]
                with localcontext() as context:
                    context.prec = DIGITS
                    root = Decimal(point) / Decimal(1 << shift)
                    scale = float(root.sqrt() / n)
                    for v in null_space(scatter, root, many):
                        rows.append((k, _as_double(v), scale))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            kinds = (pa.int32(), pa.list_(pa.float64()), pa.float64())
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["number", "vector", "scale"]
            )

    found = []
    if roots:
        tasks = min(len(roots), shuffle_partitions(spark))
        rows = spark.range(0, len(roots), 1, tasks).mapInArrow(run, _VECTOR).collect()
        found = sorted(rows, key=lambda r: (r.number, r.vector))[:most]
    kept = min(most, dims)
    components, deviations, explained = np.zeros((kept, dims)), np.zeros(kept), np.zeros(kept)
    for k, row in enumerate(found[:kept]):
        components[k], deviations[k] = row.vector, row.scale
        point, shift, _ = roots[row.number]
        with localcontext() as context:
            context.prec = DIGITS
            explained[k] = float(Decimal(point) / Decimal(1 << shift) / trace)
    return Whitening(dims, n, sums, components, deviations, explained)


def identity_error(fit: DataFrame, whitening: Whitening) -> float | None:
    """How far the covariance of the fit's whitened values is from the identity, measured on all of them.

    Their exact means are 0; what rounding leaves of these is taken off. None without a component.
    """
    kept = int((whitening.deviations > 0).sum())
    if not kept:
        return None
    upper = np.triu_indices(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kept + len(upper[0]))
        for batch in batches:
            w = whitening.project(whitening.centred(matrix_of(batch["y"], whitening.dims)))[:, :kept]
            total += np.concatenate([w.sum(axis=0), (w.T @ w)[upper]])
        yield pa.record_batch(
            [pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["pos", "value"]
        )

    sums = np.zeros(kept + len(upper[0]))
    for pos, value in fit.mapInArrow(run, _ENTRY).groupBy("pos").agg(F.sum("value")).collect():
        sums[pos] = value
    mean = sums[:kept] / whitening.n
    covariance = sums[kept:] / whitening.n - np.outer(mean, mean)[upper]
    return float(np.abs(covariance - np.eye(kept)[upper]).max())


def _apply(whitening: Whitening, error: float | None) -> Callable:
    kept = len(whitening.deviations)
    zero = whitening.deviations == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            centred = whitening.centred(matrix_of(batch["y"], whitening.dims))
            row = pa.array(np.repeat(np.arange(rows), kept))
            component = np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)
            yield pa.record_batch(
                [
                    batch["vec_id"].take(row),
                    pa.array(component),
                    pa.array(np.full(rows * kept, whitening.n)),
                    squares(centred).take(row),
                    pa.array(whitening.project(centred).ravel(), mask=np.tile(zero, rows)),
                    pa.array(np.tile(whitening.explained, rows)),
                    pa.array([error] * (rows * kept), pa.float64()),
                ],
                names=[f.split()[0] for f in _RESULT.split(", ")],
            )

    return run


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Every row that counts, projected on each of the ``most`` largest components.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``; ``deviation`` is the exact
    sum over dimensions of ``(n * x - sum)**2``, in 38 digits.
    """
    spark = embeddings.sparkSession
    rows = points(embeddings, vector)
    common = rows.groupBy(F.size("y").alias("dims")).agg(F.count("*").alias("n"))
    common = common.orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], _RESULT)
    rows = rows.where(F.size("y") == common.dims)
    fit = materialize(rows.select("y").distinct(), "whitening-fit")
    whitening = fit_whitening(spark, fit, common.dims, most)
    return rows.mapInArrow(_apply(whitening, identity_error(fit, whitening)), _RESULT)
