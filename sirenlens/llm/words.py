"""Words, lines and shingles of a whole Arrow batch at once, as 64-bit hashes (numpy, no row loop).

A word is a run of bytes other than space and U+0009..U+000D; A-Z count as a-z. Hashes are
polynomial over randomised bytes and mixed at the end, equal on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_PRIME), -1, 1 << 64))
_CHUNK = 1 << 20


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _PRIME)
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_FOLDED = _BYTES[_FOLDED]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse. Beyond the common length they are not kept."""

    def table(base: np.uint64, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    if n >= _CHUNK:
        return table(_PRIME, n + 1), table(_INVERSE, n + 1)
    if not _powers:
        _powers.extend((table(_PRIME, _CHUNK), table(_INVERSE, _CHUNK)))
    return _powers[0], _powers[1]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row begins (one more entry than rows); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)
    starts = starts[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about one megabyte, a longer row on its own."""
    first, rows = 0, len(starts) - 1
    while first < rows:
        last = int(np.searchsorted(starts, starts[first] + _CHUNK - 1, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def by_bytes(batch: pa.RecordBatch, column: str, most: int, row: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Slices of at most ``most`` bytes, a longer row on its own, with their bytes. A row counts as the
    bytes of its text and ``row`` more."""
    _, starts = raw(batch[column])
    weight = starts + row * np.arange(len(starts))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(weight, weight[first] + most, side="right")) - 1
        last = max(last, first + 1)
        yield batch.slice(first, last - first), int(weight[last] - weight[first])
        first = last


def spans(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of marked bytes; a run never crosses a row."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return begin, end


def hash_spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each span of per-byte values, wherever it stands."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each row (one more entry than rows)."""
    data, starts = raw(column)
    hashes, counts = [], []
    for first, last in pieces(starts):
        part = data[starts[first] : starts[last]]
        at = starts[first : last + 1] - starts[first]
        begin, end = spans(~_SPACE[part], at)
        hashes.append(hash_spans(_FOLDED[part], begin, end))
        counts.append(np.diff(np.searchsorted(begin, at)))
    where = np.zeros(len(starts), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=where[1:])
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), where


def shingles(hashes: np.ndarray, where: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in order, and the first of each row.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(where)
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(where), np.int64)
    np.cumsum(out, out=first[1:])
    result = np.empty(first[-1], np.uint64)
    n = max(len(hashes) - size + 1, 0)
    run = np.zeros(n, np.uint64)
    for k in range(size):
        run = run * _PRIME + hashes[k : k + n]
    run = mix(run + _U(size))
    full = np.repeat(counts >= size, out)
    # the k-th shingle of a full row begins at the k-th word of the row
    at = np.arange(first[-1]) - np.repeat(first[:-1] - where[:-1], out)
    result[full] = run[at[full]]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        z = _U(0)
        for h in hashes[where[row] : where[row + 1]]:
            z = _U((int(z) * int(_PRIME) + int(h)) & 0xFFFFFFFFFFFFFFFF)
        result[first[row]] = mix(np.array([z + _U(counts[row])], np.uint64))[0]
    return result, first
