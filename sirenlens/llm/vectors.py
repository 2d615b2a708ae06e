"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine >= c have squared distance <= 2 - 2c. Split into blocks of a rotated
basis, at least one block holds no more than its proportional share of that distance, so joining
every block within its own budget finds every pair. Rotated coordinates are whole numbers, and
budgets are as much wider as rounding can ask for: distances within a block are exact in float32, in
any order of their terms, so every task judges a pair alike.

A block is cut into cells by the signs of its coordinates about a centre. What a vector pays for
another cell is its squared distance from it; two vectors within the budget do not both pay more
than half of it for each other's cell, so the one that pays less is compared there.

Vectors are shuffled once, into files of one label and length. A task holds the vectors of a range of
a block's cells and reads the files past them, so neither pairs nor second copies of vectors are on any disk.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import components, materialize
from sirenlens.session import shared_dir

COSINE = 0.93
#: Dimensions of a block. Each has a sign, so cells have at most as many bits.
BLOCK = 16
#: Vectors of a file, if they have 64 dimensions or less; of more dimensions it holds fewer.
SIDE = 1 << 16
#: Files' worth of vectors that a task holds at once, on either side.
HELD = 2
#: Tasks of a label and length are at least so many, if it has as many files.
TASKS = 16
#: Whole numbers to a unit of length: sums of squares of two unit vectors' blocks are exact in float32.
SCALE = 1 << 11
#: Bits that the price of a cell leaves out, so twice the price of all signs is exact as well.
COARSE = 4
#: Vectors of a cell that is cut no further, and such cells whose guests are gathered once.
LEAF, LEAVES = 128, 32
#: Homes and guests that are compared at once, pairs that are judged at once.
HOMES, GUESTS, PAIRS = 128, 2048, 1 << 16
#: Digests of vectors that a writing task remembers.
SEEN = 1 << 20
#: What floating point may add to a distance of whole numbers.
SLACK = 1e-3

_IDS = "vec_id long, set_id binary, label int, dim int"
_CONTENT = "label int, dim int, part int, set_id binary, vec binary, n long"
_LINKED = "set_id binary, links long, other binary"
_MADE = f"{_LINKED}, label int, dim int, path string, n long, width int"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthonormal basis."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, width: int = BLOCK) -> list[tuple[int, int]]:
    return [(a, min(a + width, dim)) for a in range(0, dim, width)]


def budgets(dim: int, cosine: float) -> list[int]:
    """Squared distances within a block, in whole numbers. Rounding moves both ends of a distance by
    half at most in each coordinate."""
    farthest = math.sqrt(max(0.0, 2 - 2 * cosine))
    near = [SCALE * farthest * math.sqrt((b - a) / dim) + math.sqrt(b - a) + SLACK for a, b in blocks_of(dim)]
    return [int(r * r) for r in near]


def held(dim: int, most: int) -> int:
    """Of ``most`` vectors of 64 dimensions, as many as take their place."""
    return max(1, most * 64 // max(64, dim))


# ------------------------------------------------------------------ rows


def _digest(label: int, values: np.ndarray) -> bytes:
    return hashlib.blake2b(str(label).encode() + b":" + values.tobytes(), digest_size=16).digest()


def _able(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors that can link, by their length: their rows and their values."""
    lists = batch["embedding"]
    start = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(start)
    able = batch["label"].is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    able &= size > 0
    for dim in np.unique(size[able]).tolist():
        rows = np.flatnonzero(able & (size == dim))
        x = flat[start[rows][:, None] + np.arange(dim)].astype(np.float64) + 0.0  # a null component is not a number here
        scale = np.abs(x).max(axis=1)
        fine = np.isfinite(scale) & (scale > 0)
        yield rows[fine], x[fine]


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each vector; those that can link carry a digest of label and values."""
    for batch in batches:
        labels = batch["label"].to_pylist()
        keys: list[bytes | None] = [None] * len(labels)
        dims: list[int | None] = [None] * len(labels)
        for rows, x in _able(batch):
            for row, values in zip(rows.tolist(), x, strict=True):
                keys[row], dims[row] = _digest(labels[row], values), len(values)
        yield pa.record_batch(
            [batch["vec_id"].cast(pa.int64()), pa.array(keys, pa.binary()), batch["label"].cast(pa.int32()), pa.array(dims, pa.int32())],
            names=["vec_id", "set_id", "label", "dim"],
        )


def _contents(parts: dict[tuple[int, int], int]):
    """The distinct vectors of each batch with their copies. A task gives the values of a vector once
    (again only after SEEN others), so many copies are not many values for the task that gathers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            labels = batch["label"].to_pylist()
            out: list[tuple] = []
            for rows, x in _able(batch):
                dim = x.shape[1]
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                exact = (short == x).all(axis=1).tolist()
                first: dict[bytes, int] = {}
                count: dict[bytes, int] = defaultdict(int)
                for k, row in enumerate(rows.tolist()):
                    key = _digest(labels[row], x[k])
                    first.setdefault(key, k)
                    count[key] += 1
                for key, k in first.items():
                    label = labels[rows[k]]
                    part = int.from_bytes(key[:8], "big") % parts.get((label, dim), 1)
                    vec = None if key in seen else (short if exact[k] else x)[k].tobytes()
                    out.append((label, dim, part, key, vec, count[key]))
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["label", "dim", "part", "set_id", "vec", "n"],
            )

    return run


# ------------------------------------------------------------------ vectors in memory and in files


class _Chunk(NamedTuple):
    """Distinct vectors of one label and length: rotated in whole numbers, rows of each, digests, values."""

    rot: np.ndarray
    copies: np.ndarray
    keys: np.ndarray
    values: np.ndarray


class _File:
    """A chunk in a file, of which only what is asked for is read."""

    def __init__(self, path: str, n: int, dim: int, width: int) -> None:
        self.path, self.n, self.dim, self.width = path, n, dim, width

    def _read(self, at: int, kind: str, each: int) -> np.ndarray:
        system, name = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(name) as file:
            return np.frombuffer(file.read_at(self.n * each * np.dtype(kind).itemsize, self.n * at), kind)

    @property
    def rot(self) -> np.ndarray:
        return self._read(0, "i2", self.dim).reshape(-1, self.dim)

    @property
    def copies(self) -> np.ndarray:
        return self._read(2 * self.dim, "i8", 1)

    @property
    def keys(self) -> np.ndarray:
        return self._read(2 * self.dim + 8, "V16", 1)

    @property
    def values(self) -> np.ndarray:
        return self._read(2 * self.dim + 24, f"f{self.width}", self.dim).reshape(-1, self.dim)

    @staticmethod
    def write(path: str, chunk: _Chunk) -> None:
        system, name = fs.FileSystem.from_uri(path)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as out:
            for column in chunk:
                out.write(np.ascontiguousarray(column).tobytes())


class _Side:
    """Vectors as a block sees them, by their cells: ``sign`` and ``cost`` of each coordinate, ``where`` they are."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], cut: tuple[int, int], centre: np.ndarray) -> None:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        sign, cost = _cells(columns[0][:, slice(*cut)], centre[slice(*cut)])
        cell = sign @ (1 << np.arange(sign.shape[1])[::-1])
        order = np.argsort(cell, kind="stable")
        columns, sign, cost, cell = [c[order] for c in columns], sign[order], cost[order], cell[order]
        self.rot, self.copies, self.keys, self.where = columns
        self.cell, self.sign, self.cost = cell, np.ascontiguousarray(sign.T), np.ascontiguousarray(cost.T)
        self.cut = cut

    def terms(self, guest: bool) -> np.ndarray:
        """Rows whose products of a home's and a guest's are minus their squared distance."""
        part = self.rot[:, slice(*self.cut)].astype(np.float32)
        square = -np.einsum("ij,ij->i", part, part)[:, None]
        one = np.ones_like(square)
        return np.hstack([part, one, square] if guest else [2 * part, square, one])


def _cells(part: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each coordinate the side of the centre, and the price of the other side."""
    off = part - centre
    return off >= 0, (off * off).astype(np.int32) >> COARSE


def _minus(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Minus the squared distances of rows, exact as long as they are short of two units."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    return 2 * x @ y.T - np.einsum("ij,ij->i", x, x)[:, None] - np.einsum("ij,ij->i", y, y)


# ------------------------------------------------------------------ pairs


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _reach(cell: np.ndarray, sign: np.ndarray, cost: np.ndarray, base: int, node: tuple, most: int) -> Iterator[tuple]:
    """``node`` cut by sign until its homes are ``most``: nodes are a range of homes, whose cells agree up to a
    level, and the guests that can pay for them, with what these have left. Signs begin at level ``base``."""
    width = base + len(sign)
    stack = [node]
    while stack:
        low, high, level, at, left = stack.pop()
        if high - low <= most or level == width:
            yield low, high, level, at, left
            continue
        bit = width - 1 - level
        above = (int(cell[low]) >> bit | 1) << bit
        middle = low + int(np.searchsorted(cell[low:high], above))
        below, price = sign[level - base].take(at), cost[level - base].take(at)
        for a, b, away in ((low, middle, below), (middle, high, ~below)):
            if a < b:
                rest = left - price * away
                can = np.flatnonzero(rest >= 0)
                if len(can):
                    stack.append((a, b, level + 1, at.take(can), rest.take(can)))


def _candidates(
    homes: _Side, guests: _Side, level: int, left: np.ndarray, block: int, limits: list[int]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a home and a guest within the block's budget."""
    x, y = homes.terms(guest=False), guests.terms(guest=True)
    room, taken = np.empty(HOMES * GUESTS, np.float32), np.empty((GUESTS, y.shape[1]), np.float32)
    cuts = blocks_of(homes.rot.shape[1])
    count = lambda n: np.arange(n, dtype=np.int32)
    every = (0, len(homes.cell), level, count(len(left)), left.astype(np.int32))
    for low, high, level, at, left in _reach(homes.cell, guests.sign, guests.cost, 0, every, LEAVES * LEAF):
        # the guests of some leaves lie together, so that they stay in a cache
        sign, cost, rows = guests.sign[level:].take(at, axis=1), guests.cost[level:].take(at, axis=1), y.take(at, axis=0)
        node = (low, high, level, count(len(at)), left)
        for low, high, _, some, _ in _reach(homes.cell, sign, cost, level, node, LEAF):
            for j in range(0, len(some), GUESTS):
                guest = some[j : j + GUESTS]
                columns = rows.take(guest, axis=0, out=taken[: len(guest)], mode="clip").T
                for i in range(low, high, HOMES):
                    many = min(HOMES, high - i)
                    minus = np.matmul(x[i : i + many], columns, out=room[: many * len(guest)].reshape(many, -1))
                    home = np.flatnonzero(minus.max(axis=1) >= -limits[block])
                    if not len(home):
                        continue
                    near = minus[home] >= -limits[block]
                    home, abroad = home + i, at[guest]
                    if np.count_nonzero(near) * 64 > minus.size:  # of many, the pairs of other tiles go at once
                        for cut, limit in zip(cuts[:block], limits, strict=False):
                            near &= _minus(homes.rot[home, slice(*cut)], guests.rot[abroad, slice(*cut)]) < -limit
                        near &= _first(homes, guests, home, abroad)
                    p, q = np.divmod(np.flatnonzero(near), len(abroad))
                    yield home[p], abroad[q]


def _first(homes: _Side, guests: _Side, home: np.ndarray, guest: np.ndarray) -> np.ndarray:
    """Whether a pair is that of these homes and guests, and not that of the same two as guest and home."""
    sign = [np.where(s, np.float32(1), np.float32(-1)).T for s in (homes.sign[:, home], guests.sign[:, guest])]
    cost = [c.T.astype(np.float32) for c in (homes.cost[:, home], guests.cost[:, guest])]
    away = cost[0].sum(axis=1)[:, None] - (cost[0] * sign[0]) @ sign[1].T
    here = cost[1].sum(axis=1) - sign[0] @ (cost[1] * sign[1]).T
    return (here < away) | ((here == away) & (guests.where[guest] < homes.where[home][:, None]))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v.astype(np.float64) for v in (x, y))
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    norms = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y)]
    return np.einsum("ij,ij->i", x, y) / (norms[0] * norms[1])


def _values(chunks: list, where: np.ndarray) -> np.ndarray:
    out = np.empty((len(where), chunks[0].rot.shape[1]))
    for k in np.unique(where >> 32).tolist():
        here = where >> 32 == k
        out[here] = chunks[k].values[where[here] & 0xFFFFFFFF]
    return out


def _judge(
    homes: _Side, guests: _Side, p: np.ndarray, q: np.ndarray, block: int, limits: list[int], cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates are links, and of which only their values tell.

    A pair belongs to its first block within budget, and there to the one that pays less (of two
    that pay the same, to the one that comes first), so it is counted once.
    """
    dim = homes.rot.shape[1]
    apart = homes.rot[p].astype(np.int32) - guests.rot[q]
    squares = np.add.reduceat(apart * apart, [a for a, _ in blocks_of(dim)], axis=1)
    differ = homes.sign[:, p] != guests.sign[:, q]
    away, here = (homes.cost[:, p] * differ).sum(axis=0), (guests.cost[:, q] * differ).sum(axis=0)
    own = (here < away) | ((here == away) & (guests.where[q] < homes.where[p]))
    own &= squares[:, block] <= limits[block]
    own &= (squares[:, :block] > np.array(limits[:block], np.int64)).all(axis=1)
    total = np.sqrt(squares.sum(axis=1, dtype=np.int64))
    farthest, moved = SCALE * math.sqrt(max(0.0, 2 - 2 * cosine)), math.sqrt(dim) + SLACK
    unsure = own & (np.abs(total - farthest) <= moved)
    return own & (total < farthest) & ~unsure, unsure


def _found(homes: _Side, guests: _Side, p: np.ndarray, q: np.ndarray) -> pa.Table:
    """For each linked vector the number of its links, copies counted, and one vector of its component."""
    nodes, first, at = np.unique(np.concatenate([homes.where[p], guests.where[q]]), return_index=True, return_inverse=True)
    links = np.bincount(at, np.concatenate([guests.copies[q], homes.copies[p]]), len(nodes)).astype(np.int64)
    keys = np.concatenate([homes.keys[p], guests.keys[q]])[first]
    label = _labels(len(nodes), at[: len(p)], at[len(p) :])
    fixed = lambda v: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(v), [None, pa.py_buffer(v.tobytes())])
    return pa.table(
        [fixed(keys).cast(pa.binary()), pa.array(links, pa.int64()), fixed(keys[label]).cast(pa.binary())],
        names=["set_id", "links", "other"],
    )


def _some(pairs: Iterator[tuple[np.ndarray, np.ndarray]], many: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, ``many`` at a time and the rest at the end."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for pair in pairs:
        waiting.append(pair)
        n += len(pair[0])
        if n >= many:
            p, q = (np.concatenate(c) for c in zip(*waiting, strict=True))
            for at in range(0, n - many + 1, many):
                yield p[at : at + many], q[at : at + many]
            n %= many
            waiting = [(p[len(p) - n :], q[len(q) - n :])]
    if n:
        p, q = (np.concatenate(c) for c in zip(*waiting, strict=True))
        yield p, q


def _settled(
    chunks: list, homes: _Side, guests: _Side, pairs: list[tuple[np.ndarray, np.ndarray]], cosine: float
) -> Iterator[pa.Table]:
    """The links of pairs that are as near to the limit as rounding moves them."""
    p, q = (np.concatenate(c) for c in zip(*pairs, strict=True))
    linked = _cosines(_values(chunks, homes.where[p]), _values(chunks, guests.where[q])) >= cosine
    if linked.any():
        yield _found(homes, guests, p[linked], q[linked])


def _sides(chunks: list, wanted: range, pick: Callable, view: Callable, most: int) -> Iterator[_Side]:
    """The picked vectors of the wanted chunks, about ``most`` at a time."""
    parts, n = [], 0
    for k in wanted:
        rot = chunks[k].rot
        rows = pick(rot)
        if len(rows):
            parts.append((rot[rows], chunks[k].copies[rows], chunks[k].keys[rows], (k << 32) + rows))
            n += len(rows)
        if n >= most:
            yield view(parts)
            parts, n = [], 0
    if n:
        yield view(parts)


def _links(chunks: list, block: int, bits: int, prefix: int, wanted: range, most: int, cosine: float) -> Iterator[pa.Table]:
    """Links in a block between homes, of the cells that begin with ``bits`` of ``prefix``, and guests of the
    ``wanted`` chunks."""
    sample = chunks[0].rot
    dim = sample.shape[1]
    cut, limits = blocks_of(dim)[block], budgets(dim, cosine)
    half = limits[block] >> (COARSE + 1)
    centre = np.rint(sample.mean(axis=0)).astype(np.float32)
    begin = np.array([prefix >> k & 1 for k in reversed(range(bits))], bool)
    head = slice(cut[0], cut[0] + bits)

    def at_home(rot: np.ndarray) -> np.ndarray:
        return np.flatnonzero((_cells(rot[:, head], centre[head])[0] == begin).all(axis=1))

    def paid(sign: np.ndarray, cost: np.ndarray) -> np.ndarray:
        return (cost * (sign != begin)).sum(axis=1)

    def can_come(rot: np.ndarray) -> np.ndarray:
        return np.flatnonzero(paid(*_cells(rot[:, head], centre[head])) <= half)

    def view(parts: list) -> _Side:
        return _Side(parts, cut, centre)

    for homes in _sides(chunks, range(len(chunks)), at_home, view, most):
        for guests in _sides(chunks, wanted, can_come, view, most):
            left = half - paid(guests.sign[:bits].T, guests.cost[:bits].T)
            many = held(dim, PAIRS)
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            n = 0
            for p, q in _some(_candidates(homes, guests, bits, left, block, limits), many):
                linked, unsure = _judge(homes, guests, p, q, block, limits, cosine)
                if linked.any():
                    yield _found(homes, guests, p[linked], q[linked])
                waiting.append((p[unsure], q[unsure]))
                n += int(unsure.sum())
                if n >= many:
                    yield from _settled(chunks, homes, guests, waiting, cosine)
                    waiting, n = [], 0
            if n:
                yield from _settled(chunks, homes, guests, waiting, cosine)


# ------------------------------------------------------------------ tasks


def _made(found: list[pa.Table], files: list[tuple]) -> pa.Table:
    """Rows of links, and after them rows of files."""
    columns = dict(zip(("label", "dim", "path", "n", "width"), zip(*files, strict=True) if files else [()] * 5, strict=True))
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32())
    written = pa.table([pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True)], names=list(columns))
    none = pa.table([pa.array([], k) for k in (pa.binary(), pa.int64(), pa.binary())], names=["set_id", "links", "other"])
    return pa.concat_tables([none, *found, written], promote_options="default").combine_chunks()


def _gather(parts: dict[tuple[int, int], int], folder: str, most: int, cosine: float):
    """The distinct vectors of a group: their links, if a label and length is one group, else a file."""

    def run(table: pa.Table) -> pa.Table:
        label, dim = table["label"][0].as_py(), table["dim"][0].as_py()
        kept: dict[bytes, bytes] = {}
        count: dict[bytes, int] = defaultdict(int)
        for key, vec, n in zip(*(table[c].to_pylist() for c in ("set_id", "vec", "n")), strict=True):
            count[key] += n
            if vec is not None:
                kept[key] = vec
        order = sorted(kept)
        values = np.stack([np.frombuffer(kept[k], np.float32 if len(kept[k]) == 4 * dim else np.float64) for k in order])
        unit = values.astype(np.float64)
        unit /= np.abs(unit).max(axis=1, keepdims=True)
        unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
        rot = np.rint(unit @ rotation(dim) * SCALE).astype(np.int16)
        chunk = _Chunk(rot, np.array([count[k] for k in order], np.int64), np.frombuffer(b"".join(order), "V16"), values)
        if parts.get((label, dim), 1) > 1:
            path = f"{folder}/{uuid.uuid4().hex}"
            _File.write(path, chunk)
            return _made([], [(label, dim, path, len(order), values.itemsize)])
        if len(order) == 1:
            return _made([], [])
        blocks = range(len(blocks_of(dim)))
        return _made([t for block in blocks for t in _links([chunk], block, 0, 0, range(1), held(dim, most), cosine)], [])

    return run


def _search(groups: list[list[tuple]], tasks: list[tuple], most: int, cosine: float):
    """The links of tasks, by their number: (group, block, bits, prefix, share of the chunks, shares)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch["id"].to_pylist():
                group, block, bits, prefix, share, shares = tasks[number]
                chunks = [_File(*file) for file in groups[group]]
                wanted = range(share, len(chunks), shares)
                for table in _links(chunks, block, bits, prefix, wanted, held(chunks[0].dim, most), cosine):
                    yield from table.to_batches()

    return run


def _plan(groups: list[list[tuple]], most: int) -> list[tuple]:
    """Tasks of each group: a range of a block's cells that holds about ``most`` vectors, and a share of the files."""
    tasks = []
    for number, files in enumerate(groups):
        dim, n = files[0][2], sum(file[1] for file in files)
        cuts = blocks_of(dim)
        for block, (a, b) in enumerate(cuts):
            bits = min(b - a, max(0, math.ceil(math.log2(n / held(dim, most)))))
            shares = max(1, min(len(files), TASKS // (len(cuts) << bits)))
            tasks += [(number, block, bits, prefix, share, shares) for prefix in range(1 << bits) for share in range(shares)]
    return tasks


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``.

    Vectors are compared when their labels are equal and not null and their lengths agree. A null
    or empty vector, a zero one, and one with null or non-finite components links with nothing and
    is its own component. Rows with equal label and values are one vector with a count, and link
    with each other. ``component_id`` is the smallest ``vec_id`` reachable (null ids have none).

    ``vectors`` is read twice: for the digests, and for the values.
    """
    spark, side = vectors.sparkSession, SIDE
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    ids = materialize(rows.mapInArrow(_identify, _IDS), "vectors")
    able = ids.where("set_id is not null")
    full = F.expr(f"greatest(1, {side} * 64 div greatest(64, dim))")  # as held() has it
    large = able.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > full).collect()
    parts = {(r.label, r.dim): -(-r.n // held(r.dim, side)) for r in large}  # no more than files
    folder = f"{shared_dir(spark)}/sirenlens/vectors-files-{uuid.uuid4().hex}"
    contents = rows.mapInArrow(_contents(parts), _CONTENT)
    made = contents.groupBy("label", "dim", "part").applyInArrow(_gather(parts, folder, HELD * side, cosine), _MADE)
    made = materialize(made, "vectors-made")
    files: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for r in made.where("path is not null").select("label", "dim", "path", "n", "width").collect():
        files[r.label, r.dim].append((r.path, r.n, r.dim, r.width))
    linked = made.where("path is null").select("set_id", "links", "other")
    groups = list(files.values())
    if tasks := _plan(groups, HELD * side):
        numbers = spark.range(0, len(tasks), 1, len(tasks))
        found = numbers.mapInArrow(_search(groups, tasks, HELD * side, cosine), _LINKED)
        linked = linked.unionByName(materialize(found, "vectors-linked"))
    links = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    root = components(linked.select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    # one row for each distinct vector that has links or copies
    copies = able.groupBy("set_id").agg(F.count("*").alias("copies")).where("copies > 1")
    summed = copies.join(links, "set_id", "full_outer").join(root.withColumnRenamed("node", "set_id"), "set_id", "left")
    summed = materialize(
        summed.select(
            "set_id",
            (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
            F.coalesce("root", "set_id").alias("part"),
        ),
        "vectors-summed",
    )
    named = materialize(ids.select("vec_id", "set_id").join(summed, "set_id", "left").drop("set_id"), "vectors-named")
    least = named.where("part is not null").groupBy("part").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"))
    least = materialize(least.where("m > 1"), "vectors-components")
    out = named.join(least, "part", "left")
    out = out.withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
