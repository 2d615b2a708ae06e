"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, and
an exact weighted-shingle check.

The benchmark is the query set. It is dealt into blocks of bounded size, and one task for each block
builds its index, which is written. For each block every document is read once, nothing of it is
shuffled, and what it holds is written before the next block's index is fetched: the driver and the
workers hold one index at a time, and no text of the benchmark. A window has as many words as the item. Its
SimHash is looked up in an index of the items' fingerprints: cut into blocks of bits, two
fingerprints within the radius differ by at most ``RADIUS // BLOCKS`` bits in one of the blocks, and the
index holds every such variant of every block, so no fingerprint within the radius is missed.
Candidates are verified by the weighted Jaccard similarity of their five-word shingles, each
weighted by how often it occurs. Windows without any shingle of the items have similarity 0 and
are not fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import materialize
from sirenlens.llm.words import shingles, words

SIZE = 5
SIMILARITY = 0.75
#: Of 64 bits. At the similarity above, fingerprints differ in about 11 (standard deviation 3).
RADIUS = 19
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Benchmark items, and bytes of their texts, that one pass over the documents looks for (an index
#: of about 100 MB).
ITEMS, ITEM_BYTES = 4_000, 4 << 20
#: Bytes of an index in one row of the written table.
PIECE = 4 << 20

_INDEX = "block long, name string, kind string, at long, data binary"
_FOUND = "doc_id long, item_id long, similarity double, word_at long, n_words long"


def simhash(grams: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows of ``width`` shingles that start at ``begin``.

    Every occurrence of a shingle votes once, so a shingle's weight is how often it occurs.
    """
    out = np.zeros(len(begin), np.uint64)
    votes = np.zeros(len(grams) + 1, np.int32)
    for bit in range(64):
        np.cumsum((grams >> np.uint64(bit)) & np.uint64(1), out=votes[1:], dtype=np.int32)
        ones = votes[begin + width] - votes[begin]
        out |= (2 * ones > width).astype(np.uint64) << np.uint64(bit)
    return out


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights of all shingles of either."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


class Index:
    """The items of one block, their shingles, and the multi-index of their fingerprints.

    ``arrays`` is all of it; ``Index(arrays=...)`` only looks into them. A null id stays null.
    """

    def __init__(
        self,
        ids: list[int | None] | None = None,
        texts: list[str] | None = None,
        radius: int = RADIUS,
        arrays: dict[str, np.ndarray] | None = None,
    ):
        self.arrays = arrays if arrays is not None else self._build(ids, texts, radius)
        get = self.arrays.__getitem__
        self.radius = int(get("radius")[0])
        self.ids = [i if there else None for i, there in zip(get("ids").tolist(), get("has_id").tolist(), strict=True)]
        self.words, self.known, self.holder, self.prints = get("words"), get("known"), get("holder"), get("prints")
        self.entries, self.items = get("entries"), get("items")
        grams, first = get("grams"), get("first").tolist()
        self.grams = [grams[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        # most shingles of a document are ruled out by a bitmap of fixed size
        self.bitmap = np.zeros(1 << 24, bool)
        self.bitmap[self.known >> np.uint64(40)] = True

    @classmethod
    def _build(cls, ids: list[int | None], texts: list[str], radius: int) -> dict[str, np.ndarray]:
        hashes, where = words(pa.array(texts, pa.string()))
        grams, first = shingles(hashes, where, SIZE)
        lengths = np.diff(first)
        owner = np.repeat(np.arange(len(ids)), lengths)
        order = np.lexsort((owner, grams))
        known, holder = grams[order], owner[order]
        new = np.ones(len(known), bool)
        new[1:] = (known[1:] != known[:-1]) | (holder[1:] != holder[:-1])
        prints = np.zeros(len(ids), np.uint64)
        for width in np.unique(lengths[lengths > 0]).tolist():
            mine = np.flatnonzero(lengths == width)
            of = grams[(first[mine][:, None] + np.arange(width)).ravel()]
            prints[mine] = simhash(of, np.arange(len(mine)) * width, width)
        entries, items = cls._entries(prints, lengths, radius)
        return {
            "radius": np.array([radius], np.int64), "ids": np.array([i or 0 for i in ids], np.int64),
            "has_id": np.array([i is not None for i in ids], bool), "words": np.diff(where).astype(np.int64),
            "grams": grams, "first": np.asarray(first, np.int64), "known": known[new],
            "holder": holder[new].astype(np.int64), "prints": prints, "entries": entries, "items": items,
        }

    @classmethod
    def _entries(cls, prints: np.ndarray, lengths: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys of all variants of all blocks of bits, and the item of each."""
        keys, items = [], []
        for number, (start, bits) in enumerate(BLOCKS):
            masks = np.array(
                [
                    sum(1 << b for b in flipped)
                    for count in range(radius // len(BLOCKS) + 1)
                    for flipped in combinations(range(bits), count)
                ],
                np.uint64,
            )
            values = (prints >> np.uint64(start)) & np.uint64((1 << bits) - 1)
            keys.append(cls._key(lengths[:, None], number, values[:, None] ^ masks[None, :]).ravel())
            items.append(np.repeat(np.arange(len(prints)), len(masks)))
        every, item = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(every, kind="stable")
        return every[order], item[order].astype(np.int32)

    @staticmethod
    def _key(width, number: int, values: np.ndarray) -> np.ndarray:
        return (np.asarray(width, np.uint64) << np.uint64(16)) | np.uint64(number << 13) | values

    def candidates(self, width: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) of equal length whose fingerprints are within the radius."""
        pairs = []
        for number, (start, bits) in enumerate(BLOCKS):
            values = (prints >> np.uint64(start)) & np.uint64((1 << bits) - 1)
            keys = self._key(width, number, values)
            lo, hi = (np.searchsorted(self.entries, keys, side=side) for side in ("left", "right"))
            count = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            pairs.append(np.repeat(np.arange(len(prints)), count) * len(self.ids) + self.items[at])
        pair = np.unique(np.concatenate(pairs))
        w, k = pair // len(self.ids), pair % len(self.ids)
        close = np.bitwise_count(prints[w] ^ self.prints[k]) <= self.radius
        return w[close], k[close]

    def search(self, grams: np.ndarray, n_words: int) -> list[tuple[int, float, int]]:
        """``(item, similarity, first word)`` of the best window of each item found in a document."""
        hit = np.flatnonzero(self.bitmap[grams >> np.uint64(40)])
        lo = np.searchsorted(self.known, grams[hit], side="left")
        hi = np.searchsorted(self.known, grams[hit], side="right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(hit):
            return []
        place = np.repeat(hit, hi - lo)
        item = self.holder[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])]
        widths = np.array([len(g) for g in self.grams])
        best: dict[int, tuple[float, int]] = {}
        for width in np.unique(widths[item]).tolist():
            size = min(width, len(grams))  # a document shorter than the item is one window
            at = np.unique(place[widths[item] == width])
            begin = np.unique((at[:, None] - np.arange(size)).ravel())
            begin = begin[(begin >= 0) & (begin + size <= len(grams))]
            # only the stretch that the windows cover is fingerprinted
            low = int(begin[0])
            prints = simhash(grams[low : int(begin[-1]) + size], begin - low, size)
            for w, k in zip(*self.candidates(width, prints), strict=True):
                b = int(begin[w])
                if (self.words[k] < SIZE) != (n_words < SIZE):
                    continue
                score = weighted_jaccard(grams[b : b + size], self.grams[k])
                if score > best.get(int(k), (0.0, 0))[0]:
                    best[int(k)] = (score, b)
        return [(k, score, b) for k, (score, b) in sorted(best.items())]


def _matches(index: Index, column: pa.Array, similarity: float) -> Iterator[tuple[int, int, float, int]]:
    """``(row, item, similarity, first word)`` of all items found in a column of texts."""
    hashes, where = words(column)
    grams, first = shingles(hashes, where, SIZE)
    before = np.concatenate([[0], np.cumsum(index.bitmap[grams >> np.uint64(40)])])
    for row in np.flatnonzero(before[first[1:]] > before[first[:-1]]).tolist():
        n = int(where[row + 1] - where[row])
        for k, score, at in index.search(grams[first[row] : first[row + 1]], n):
            if score >= similarity:
                yield row, k, score, at


def _search(shared: Broadcast, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(arrays=shared.value)
        for batch in batches:
            out = [
                (batch["doc_id"][row].as_py(), index.ids[k], score, at, int(index.words[k]))
                for row, k, score, at in _matches(index, batch["text"], similarity)
            ]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "similarity", "word_at", "n_words"],
            )

    return run


def _rows(shared: Broadcast, similarity: float, holding: bool):
    """Only the rows that hold an item, or only those that hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(arrays=shared.value)
        for batch in batches:
            held = {row for row, *_ in _matches(index, batch["text"], similarity)}
            yield batch.filter(pa.array([(row in held) == holding for row in range(len(batch))], pa.bool_()))

    return run


def _index_rows(block: tuple, items: pa.Table) -> pa.Table:
    """The index of one block, each array in pieces."""
    items = items.sort_by([("item_id", "ascending"), ("text", "ascending")])
    arrays = Index(items["item_id"].to_pylist(), items["text"].to_pylist()).arrays
    rows = [
        (block[0].as_py(), name, str(x.dtype), at, raw[at : at + PIECE])
        for name, x in arrays.items()
        for raw in [x.tobytes()]
        for at in range(0, max(1, len(raw)), PIECE)
    ]
    return pa.table(dict(zip(("block", "name", "kind", "at", "data"), map(list, zip(*rows, strict=True)), strict=True)))


def written_index(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The written indexes of all blocks of the benchmark, and how many blocks there are.

    Equal rows are one item; rows without text are none.
    """
    items = benchmark.where("text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    items = items.distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // ITEMS), -(-(size or 0) // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))).alias("block")
    built = items.select(block, "item_id", "text").groupBy("block").applyInArrow(_index_rows, _INDEX)
    return materialize(built, "benchmark-index"), blocks


def _fetched(index: DataFrame, block: int) -> Broadcast | None:
    """One block's index for the workers, each of which loads it once; none if nothing fell there."""
    rows = index.where(F.col("block") == block).orderBy("name", "at").toArrow().to_pylist()
    if not rows:
        return None
    raw: dict[str, list] = {}
    for row in rows:
        raw.setdefault(row["name"], [np.dtype(row["kind"])]).append(row["data"])
    arrays = {name: np.frombuffer(b"".join(data), kind) for name, (kind, *data) in raw.items()}
    return index.sparkSession.sparkContext.broadcast(arrays)


def without_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark; no text is shuffled.

    One block is a filter. Of more, each writes the keys of the rows that it finds, and these go at the end.
    """
    index, blocks = written_index(benchmark)
    if blocks <= 1:
        shared = _fetched(index, 0)
        return docs if shared is None else docs.mapInArrow(_rows(shared, similarity, False), docs.schema)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = None
    for block in range(blocks):
        if (shared := _fetched(index, block)) is not None:
            held = keyed.mapInArrow(_rows(shared, similarity, True), keyed.schema)
            part = materialize(held.select(F.col("doc_id").alias("_hit_id"), F.col("h").alias("_hit_h")), "benchmark-hits")
            shared.destroy()
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs
    hits = found.distinct()
    same = (F.xxhash64(docs["text"]) == hits["_hit_h"]) & docs["doc_id"].eqNullSafe(hits["_hit_id"])
    return docs.join(hits, same, "left_anti")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, word_at, n_words`` of every document that holds an item.

    One row for each document row and item: the most similar window, its first word (from 0) and
    its length. A-Z count as a-z. An item without words is found nowhere; one of fewer than five
    words only as a whole document. Null texts hold nothing; null and repeated ids are kept. Repeated rows of
    the benchmark are one item.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index, blocks = written_index(benchmark)
    found = texts.sparkSession.createDataFrame([], _FOUND)
    for block in range(blocks):
        if (shared := _fetched(index, block)) is not None:
            part = texts.mapInArrow(_search(shared, similarity), _FOUND)
            if blocks == 1:
                return part
            found = found.unionByName(materialize(part, "benchmark-found"))
            shared.destroy()
    return found
