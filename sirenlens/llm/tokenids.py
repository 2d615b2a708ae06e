"""Token ids in binary files: Simple-8b words, with escapes and per-block offsets.

Documents are range-partitioned by id, encoded where they are written, and lie in the files in
ascending id order, each followed by an end id. A file is a run of blocks of ``BLOCK`` ids. A block is
a run of 64-bit words: four selector bits say how many ids the other sixty hold, in how many bits each;
an id of more than sixty bits is an escape, a word of its own behind its selector. The footer has the
word at which every block begins and the id at which every document ends, so a reader decodes any
blocks, all at once, without what lies before them.

A null text is the empty text and has its end id alone. Null document ids come last; rows of one id go
by a hash of their text, and rows equal in both are all kept. Further columns are ignored. An empty
table has no files and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import shuffle_partitions
from sirenlens.llm.tokens import tokenizer_path
from sirenlens.llm.words import raw
from sirenlens.operators.ordered import with_running
from sirenlens.session import materialize

MAGIC = b"S8BIDS01"
#: Ids of a block.
BLOCK = 4096
#: Blocks that are packed or decoded at once (a million ids).
GROUP = 256
#: Bytes of words after which a writing task begins another file, at the end of a document.
FILE = 64 << 20
#: Pieces of text whose ids a Python worker remembers (about 100 MB); then it forgets the rare ones.
REMEMBERED = 500_000
#: Pieces that the library gets as one text.
LINES = 1000

#: Ids in a word and bits of each, by selector; selector 0 is the escape.
_COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
_BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_U = np.uint64
_TRAILER = struct.Struct("<QQQI8s")  # ids, documents, blocks, CRC-32 of the tables before it, magic

_MANIFEST = "path string, part long, number long, bytes long, n_ids long, n_docs long"


# -- the words --------------------------------------------------------------------------------


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; an id beyond 2**53 may seem one bit wider."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``ids`` and how many words each block of ``BLOCK`` ids has.

    Every block takes at each place the selector that holds most ids. What a selector can hold is
    known for all places from running maxima of the widths; then all blocks advance together.
    """
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    padded = np.zeros((blocks, BLOCK + int(_COUNTS.max())), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = ids
    padded[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _widths(padded)
    choice = np.zeros((blocks, BLOCK), np.uint8)  # the escape
    widest, reach = width, 1
    for selector in range(15, 0, -1):  # ever more ids in a word
        count = int(_COUNTS[selector])
        while reach < count:  # widest[i] becomes the maximum of `count` widths from i on
            step = min(reach, count - reach)
            ahead = np.zeros_like(widest)
            ahead[:, :-step] = widest[:, step:]
            widest, reach = np.maximum(widest, ahead), reach + step
        choice[widest[:, :BLOCK] <= _BITS[selector]] = selector
    last = np.full(blocks, BLOCK)
    last[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, np.int64), np.arange(blocks)
    owners, places, selectors = [], [], []
    while len(live):
        chosen = choice[live, at[live]]
        owners.append(live)
        places.append(at[live])
        selectors.append(chosen)
        at[live] += _COUNTS[chosen]
        live = live[at[live] < last[live]]
    owner, place, chosen = np.concatenate(owners), np.concatenate(places), np.concatenate(selectors)
    order = np.argsort(owner * np.int64(BLOCK) + place)
    owner, place, chosen = owner[order], place[order], chosen[order]
    length = 1 + (chosen == 0)
    where = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        if selector == 0:
            words[where[mine] + 1] = padded[owner[mine], place[mine]]
            continue
        word = np.full(len(mine), _U(selector) << _U(60))
        if _BITS[selector]:
            for k in range(_COUNTS[selector]):
                word |= padded[owner[mine], place[mine] + k] << _U(k * _BITS[selector])
        words[where[mine]] = word
    return words, np.bincount(owner, weights=length, minlength=blocks).astype(np.int64)


def unpack(words: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of blocks of ``sizes`` words and ``counts`` ids each."""
    if not len(words):
        return np.empty(0, np.uint64)
    selector = (words >> _U(60)).astype(np.int64)
    is_raw = np.zeros(len(words) + 1, bool)
    for k in np.flatnonzero(selector == 0):  # escapes only: the word behind one is no selector
        if not is_raw[k]:
            is_raw[k + 1] = True
    is_raw = is_raw[:-1]
    held = np.where(is_raw, 0, _COUNTS[selector])
    before = np.cumsum(held) - held
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    stride = BLOCK + int(_COUNTS.max())
    place = before - before[begin][owner] + owner * stride
    out = np.zeros(len(sizes) * stride, np.uint64)
    for s in np.unique(selector[~is_raw]):
        mine = np.flatnonzero((selector == s) & ~is_raw)
        if s == 0:
            out[place[mine]] = words[mine + 1]
            continue
        bits = int(_BITS[s])
        if bits:
            mask = _U((1 << bits) - 1)
            for k in range(_COUNTS[s]):
                out[place[mine] + k] = (words[mine] >> _U(k * bits)) & mask
    kept = np.arange(stride) < counts[:, None]
    return out.reshape(len(sizes), stride)[kept]


# -- the ids of texts -------------------------------------------------------------------------


#: ASCII punctuation that is no part of a contraction or of a special token's string.
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


def _bounds(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin and end: places at which the byte-level pre-tokenizer begins a new word.

    These are the texts' own bounds, single spaces and line ends between two characters that are no
    white space, and marks behind a Latin letter. Places in doubt are left out: a longer piece is
    encoded as it stands.
    """
    n = len(data)
    bound = np.zeros(n + 1, bool)
    bound[starts] = True
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[~(bound[at] | bound[at + 1])]
    if len(at):
        after, one = data[at + 1], data[at - 1]
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        good = (after > 32) & ~np.isin(after, (0xC2, 0xE1, 0xE2, 0xE3)) & (one > 32)
        white = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        white |= (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81))
        white |= (three == 0xE3) & (two == 0x80)
        at = at[good & ~((one >= 0x80) & white)]
    at_mark = np.flatnonzero(_MARKS[data])
    at_mark = at_mark[~bound[at_mark]]
    one, two = data[at_mark - 1], data[np.maximum(at_mark - 2, 0)]
    accented = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    bound[at_mark[_LETTERS[one] | accented]] = True
    bound[at] = True
    bound[at[data[at] == 10] + 1] = True
    return np.flatnonzero(bound)


class Encoder:
    """Ids of whole texts, each followed by ``end``; every distinct piece of text is encoded once.

    A piece is what lies between two bounds: the library's result for a text is that of its pieces
    in a row. Pieces without white space inside go to the library many at a time, as lines of one
    text. With another pre-tokenizer than the byte-level one a piece is a whole text.
    """

    def __init__(self, name: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.end = end
        kind = str(self.library.pre_tokenizer)
        self.cuts = kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        self.cuts = self.cuts and self.library.normalizer is None
        line_end = self.ids(["\n"])[0]
        self.line_end = line_end[0] if self.cuts and len(line_end) == 1 else None
        self.forget()

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Nothing is known but the end id, which has slot 0."""
        self.known: dict[bytes, int] = {}
        self.first = np.zeros(1, np.int64)
        self.count = np.ones(1, np.int64)
        self.uses = np.zeros(1, np.int32)
        self.held = np.array([self.end], np.uint32)

    def forget_rare(self) -> None:
        """Keep the pieces that several batches had; start anew where these are too many."""
        kept = self.uses > 1
        pieces = [p for p, slot in self.known.items() if kept[slot]]
        if 2 * len(pieces) > REMEMBERED:
            return self.forget()
        slots = np.fromiter((self.known[p] for p in pieces), np.int64, len(pieces))
        counts, first = self.count[slots], self.first[slots]
        before = np.cumsum(counts) - counts
        ids = self.held[np.arange(int(counts.sum())) + np.repeat(first - before, counts)]
        self.forget()
        self._keep(pieces, counts, ids)

    def _keep(self, pieces: list[bytes], counts: np.ndarray, ids: np.ndarray) -> None:
        slots = len(self.first)
        self.known.update(zip(pieces, range(slots, slots + len(pieces)), strict=True))
        self.first = np.concatenate([self.first, len(self.held) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(pieces), np.int32)])
        self.held = np.concatenate([self.held, ids.astype(np.uint32)])

    def learn(self, missing: list[bytes]) -> None:
        lines: tuple[list[bytes], list[str]] = ([], [])
        alone: tuple[list[bytes], list[str]] = ([], [])
        for piece in missing:
            text = piece.decode()
            word = text[1:] if text[:1] == " " else text
            kept = lines if self.line_end is not None and word.split() == [word] else alone
            kept[0].append(piece)
            kept[1].append(text)
        for k in range(0, len(lines[0]), LINES):
            pieces = lines[0][k : k + LINES]
            found = np.array(self.ids(["\n".join(lines[1][k : k + LINES])])[0], np.int64)
            at = np.flatnonzero(found == self.line_end)
            if len(at) != len(pieces) - 1:
                raise ValueError("a line of pieces was not encoded as its pieces")
            counts = np.diff(np.concatenate([[-1], at, [len(found)]])) - 1
            self._keep(pieces, counts, found[found != self.line_end])
        if alone[0]:
            each = self.ids(alone[1])
            self._keep(alone[0], np.array([len(e) for e in each], np.int64), np.array([i for e in each for i in e], np.int64))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and how many each row has."""
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        data, starts = raw(column)
        bounds = _bounds(data, starts) if self.cuts else np.unique(starts)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        missing = [p for p in distinct if p not in self.known]
        if missing:
            self.learn(missing)
        slots = np.fromiter(map(self.known.__getitem__, distinct), np.int32, len(distinct))
        self.uses[slots] += 1
        inner = slots[pieces.indices.to_numpy()] if len(bounds) > 1 else np.empty(0, np.int32)
        row_ends = np.searchsorted(bounds, starts)
        slot = np.insert(inner, row_ends[1:], 0)  # every row ends in the end id
        count = self.count[slot]
        before = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        at = np.arange(before[-1], dtype=np.int32 if before[-1] < 1 << 31 else np.int64)
        at += np.repeat((self.first[slot] - before[:-1]).astype(at.dtype), count)
        ends = row_ends + np.arange(len(row_ends))  # pieces and ends before each row
        return self.held[at], np.diff(before[ends])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_for(tokenizer: str, end: int) -> Encoder:
    """A Python worker keeps its encoder, and what it has learnt, from task to task."""
    if (tokenizer, end) not in _encoders:
        _encoders[tokenizer, end] = Encoder(tokenizer, end)
    return _encoders[tokenizer, end]


# -- writing ----------------------------------------------------------------------------------


class _File:
    """One file being written under another name; ``close`` gives it its own."""

    def __init__(self, system: fs.FileSystem, root: str, name: str):
        self.system, self.target, self.draft = system, f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
        self.out = system.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = self.n_words = 0
        self.sizes: list[np.ndarray] = []
        self.doc_ids: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy().astype(np.int64))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.ends.append(self.n_ids + np.cumsum(counts))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= GROUP * BLOCK:
            together = np.concatenate(self.waiting)
            whole = len(together) // BLOCK * BLOCK
            for k in range(0, whole, GROUP * BLOCK):
                self._write(together[k : min(k + GROUP * BLOCK, whole)])
            self.waiting, self.n_waiting = [together[whole:]], len(together) - whole

    def _write(self, ids: np.ndarray) -> None:
        words, sizes = pack(ids)
        self.out.write(words.astype("<u8").tobytes())
        self.n_words += len(words)
        self.sizes.append(sizes)

    def close(self) -> tuple[str, int, int, int]:
        if self.n_waiting:
            self._write(np.concatenate(self.waiting))
        sizes, ends = np.concatenate([*self.sizes, np.empty(0, np.int64)]), np.concatenate(self.ends)
        tables = b"".join(
            x.astype(kind).tobytes()
            for x, kind in ((sizes, "<i8"), (np.concatenate(self.doc_ids), "<i8"), (ends, "<i8"), (np.concatenate(self.nulls), "u1"))
        )
        self.out.write(tables + _TRAILER.pack(self.n_ids, len(ends), len(sizes), zlib.crc32(tables), MAGIC))
        self.out.close()
        self.system.move(self.draft, self.target)
        return self.target, len(MAGIC) + 8 * self.n_words + len(tables) + _TRAILER.size, self.n_ids, len(ends)


def _write(folder: str, tokenizer: str, end: int):
    """Encode and write a partition. A task that runs again writes the same bytes to the same names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer, end)
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        part, file, done = TaskContext.get().partitionId(), None, []

        def close() -> None:
            path, size, n_ids, n_docs = file.close()
            done.append((f"{folder}/{path.rpartition('/')[2]}", part, len(done), size, n_ids, n_docs))

        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                file = _File(system, root, f"part-{part:07d}-{len(done):05d}.ids")
            file.add(batch["doc_id"], *encoder.encode(batch["text"]))
            if 8 * file.n_words >= FILE:
                close()
                file = None
        if file is not None:
            close()
        columns = list(zip(*done, strict=True)) or [()] * 6
        kinds = (pa.string(), *[pa.int64()] * 5)
        yield pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["path", "part", "number", "bytes", "n_ids", "n_docs"],
        )

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", end: int = 0) -> DataFrame:
    """Write ``docs(doc_id, text)`` under ``folder``; returns ``path, start, n_ids, n_docs, bytes`` of each file.

    ``start`` is how many ids all files before it hold. Files follow each other in ascending document
    id. The row's number in its scan is the last key of the order, so that equal rows, however many,
    are spread over tasks.
    """
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(
        doc_id.isNull().alias("last"), doc_id.alias("doc_id"), F.xxhash64("text").alias("h"),
        F.monotonically_increasing_id().alias("row"), "text",
    )
    key = ["last", "doc_id", "h", "row"]
    placed = keyed.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    written = materialize(placed.mapInArrow(_write(folder, tokenizer, end), _MANIFEST), "token-files")
    line = written.withColumn("all", F.lit(0))
    line = with_running(line, ["all"], [F.col("part"), F.col("number")], {"upto": "n_ids"})
    return line.select("path", (F.col("upto") - F.col("n_ids")).alias("start"), "n_ids", "n_docs", "bytes")


# -- reading ----------------------------------------------------------------------------------

Pieces = Iterator[tuple[int, np.ndarray]]


def read_file(path: str) -> tuple[list, np.ndarray, Pieces]:
    """Document ids, where in the file each document ends, and the ids group by group as ``(first, ids)``."""
    system, name = fs.FileSystem.from_uri(path)
    source = system.open_input_file(name)
    size = source.size()
    source.seek(size - _TRAILER.size)
    n_ids, n_docs, n_blocks, crc, magic = _TRAILER.unpack(source.read(_TRAILER.size))
    length = 8 * n_blocks + 17 * n_docs
    source.seek(size - _TRAILER.size - length)
    tables = source.read(length)
    if magic != MAGIC or zlib.crc32(tables) != crc:
        raise ValueError(f"not a whole file of token ids: {path}")
    sizes = np.frombuffer(tables, "<i8", n_blocks)
    doc_ids = np.frombuffer(tables, "<i8", n_docs, 8 * n_blocks)
    ends = np.frombuffer(tables, "<i8", n_docs, 8 * (n_blocks + n_docs))
    nulls = np.frombuffer(tables, "u1", n_docs, 8 * n_blocks + 16 * n_docs)
    offset = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(sizes, out=offset[1:])

    def groups() -> Pieces:
        with source:
            for k in range(0, n_blocks, GROUP):
                last = min(k + GROUP, n_blocks)
                source.seek(len(MAGIC) + 8 * int(offset[k]))
                words = np.frombuffer(source.read(8 * int(offset[last] - offset[k])), "<u8")
                counts = np.minimum(BLOCK, n_ids - BLOCK * np.arange(k, last))
                yield k * BLOCK, unpack(words, sizes[k:last], counts)

    return [None if null else int(d) for d, null in zip(doc_ids, nulls, strict=True)], ends, groups()


def _by_document(path: str, begin: Callable, add: Callable, finish: Callable) -> Iterator[tuple]:
    """``(doc_id, first id in the file, ids, state)`` of each document, from its groups in order."""
    doc_ids, ends, groups = read_file(path)
    at, first, state = 0, 0, begin()
    for start, ids in groups:
        while at < len(ends):
            a, b = max(first, start) - start, min(int(ends[at]), start + len(ids)) - start
            if a < b:
                state = add(state, ids[a:b])
            if ends[at] > start + len(ids):  # the rest is in the next group
                break
            yield doc_ids[at], first, int(ends[at]) - first, finish(state)
            first, at, state = int(ends[at]), at + 1, begin()


def _read(begin: Callable, add: Callable, finish: Callable, kind: pa.DataType, counted: bool, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            ids, firsts, counts, values = zip(*found, strict=True)
            columns = [("doc_id", ids, pa.int64()), ("start", firsts, pa.int64())]
            columns += [("n_tokens", counts, pa.int64())] * counted + [("value", values, kind)]
            return pa.record_batch([pa.array(v, k) for _, v, k in columns], names=[n for n, _, _ in columns])

        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                found, held = [], 0
                for doc_id, first, n, value in _by_document(path, begin, add, finish):
                    found.append((doc_id, start + first, n, value))
                    held += 1 if counted else n
                    if held >= rows:
                        yield batch_of(found)
                        found, held = [], 0
                if found:
                    yield batch_of(found)

    return run


def _dealt(files: DataFrame) -> DataFrame:
    return files.select("path", "start").repartition(shuffle_partitions(files.sparkSession), "path")


def read_ids(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document of ``files(path, start)``, its end id included."""
    read = _read(list, lambda s, ids: [*s, ids], lambda s: np.concatenate(s).astype(np.int64), pa.list_(pa.int64()), False, 1 << 18)
    found = _dealt(files).mapInArrow(read, "doc_id long, start long, value array<long>")
    return found.withColumnRenamed("value", "ids")


def read_digests(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the ids as read back, as 32-bit little-endian integers.

    A checksum goes on from group to group, so a document of any length needs the memory of one.
    """
    read = _read(int, lambda s, ids: zlib.crc32(ids.astype("<u4").tobytes(), s), int, pa.int64(), True, 10_000)
    found = _dealt(files).mapInArrow(read, "doc_id long, start long, n_tokens long, value long")
    return found.withColumnRenamed("value", "ids_crc32")
