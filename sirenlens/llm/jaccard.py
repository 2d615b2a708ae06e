"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of the n-grams is that of their 64-bit hashes. It is cut into fragments, each
fragment counts partial overlaps on its own, and the counts are summed:

1. for each document: how many of its n-grams any other document has. Two documents can only link
   when that sum reaches the threshold for both, which leaves the members of copy families.
2. for each candidate pair of distinct sets: the n-grams they share, fragment by fragment.

Candidates share an n-gram of their prefixes (rarest first), as any linked pair must. A frequent
n-gram is never expanded into all its pairs at once: its holders are compared with a hub among
them, what links is merged, and only pairs of different components are compared further. A pair
inside a component cannot change any component, so no component is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.llm.common import components, materialize, shuffle_partitions
from sirenlens.llm.words import by_bytes, shingles, words

SIZE = 5
PERCENT = 75
#: Fragments in which the overlap of a pair is counted (the top bits of a hash).
PAIR_FRAGMENTS = 8
#: Bytes of text whose n-grams a task gathers before it hands them on (about a million n-grams), and
#: what a row counts besides its text.
GATHERED, ROW = 6 << 20, 64
#: Bytes of text for each fragment of the n-gram order (about five million n-grams), where the cluster
#: does not deal more finely.
FRAGMENT = 32 << 20


_PACKED = "kind byte, batch binary, fragment long, doc_id long, h long, n long, digest binary, data binary"
_COUNTED = "doc_id long, h long, n long, digest binary, shared long"
_SEGMENT = "set_id long, n long, fragment int, grams array<long>"


def sets_of(column: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    grams, first = shingles(*words(column), size)
    return [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _pack(sets: list[np.ndarray], ids: list, keys: list, fragments: int) -> Iterator[pa.RecordBatch]:
    """Rows of the documents (kind 0) and, for each fragment, their n-grams there (kind 1).

    An n-gram is 32 bits within its fragment; two that fall together only raise a count, which is
    an upper bound. Those that several documents of the batch have are sent once, apart from the
    documents, so that a frequent n-gram costs one entry for each batch.
    """
    rows = len(sets)
    digests = [set_digest(s) if len(s) else None for s in sets]
    token = hashlib.blake2b(b"".join(d or b"\0" for d in digests) + repr((ids, keys)).encode(), digest_size=16)
    batch = token.digest()
    sizes = np.array([len(s) for s in sets], np.int64)
    everything = np.concatenate(sets) if rows else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(rows), sizes)
    order = np.argsort(everything, kind="stable")
    ranked, owner = everything[order], owner[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    last = np.ones(len(ranked), bool)
    last[:-1] = new[1:]
    single = new & last
    span = (1 << 64) // fragments + 1
    cuts = np.searchsorted(ranked, np.array([k * span for k in range(1, fragments)], np.uint64))
    cuts = np.concatenate([[0], cuts, [len(ranked)]]).astype(np.int64)
    data, where = [], []
    shared_here = np.bincount(owner, weights=~single, minlength=rows).astype(np.int64)
    alone = np.empty(len(ranked), bool)
    alone[order] = single
    alone = np.flatnonzero(alone)
    low_bits = np.uint64(max(0, span.bit_length() - 32))
    place = (everything[alone] // np.uint64(span)).astype(np.uint16 if fragments < 1 << 16 else np.uint32)
    by_place = np.argsort(place, kind="stable")  # by document within a fragment
    edges = np.searchsorted(place[by_place], np.arange(fragments + 1))
    documents = np.repeat(np.arange(rows), sizes)
    for k in range(fragments):
        mine = alone[by_place[edges[k] : edges[k + 1]]]
        part = slice(cuts[k], cuts[k + 1])
        several = ranked[part][(new & ~last)[part]]
        if not len(mine) and not len(several):
            continue
        once, more = (((x - np.uint64(k * span)) >> low_bits).astype(np.uint32) for x in (everything[mine], several))
        # the documents that have n-grams here, and how many each
        first = np.flatnonzero(np.diff(documents[mine], prepend=-1))
        who, many = documents[mine[first]], np.diff(np.append(first, len(mine)))
        head = np.concatenate([[len(who)], who, many]).astype(np.uint32)
        data.append(b"".join(x.tobytes() for x in (head, once, more)))
        where.append(k)
    yield pa.record_batch(
        [
            pa.array([0] * rows + [1] * len(data), pa.int8()),
            pa.array([batch] * (rows + len(data)), pa.binary()),
            # documents travel with the fragments, dealt evenly
            pa.array([i % fragments for i in range(rows)] + where, pa.int64()),
            pa.array(ids + [None] * len(data), pa.int64()),
            pa.array(keys + [None] * len(data), pa.int64()),
            pa.array(list(sizes) + [None] * len(data), pa.int64()),
            pa.array(digests + [None] * len(data), pa.binary()),
            pa.array([np.array([i, shared_here[i]], np.int64).tobytes() for i in range(rows)] + data, pa.binary()),
        ],
        schema=_schema(),
    )


def _schema() -> pa.Schema:
    return pa.schema(
        [("kind", pa.int8()), ("batch", pa.binary()), ("fragment", pa.int64()), ("doc_id", pa.int64()),
         ("h", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("data", pa.binary())]
    )


def _fragments_of(size: int, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        ids: list = []
        keys: list = []
        held = 0
        for batch in batches:
            for part, weight in by_bytes(batch, "text", GATHERED, ROW):
                sets.extend(sets_of(part["text"], size))
                ids.extend(part["doc_id"].to_pylist())
                keys.extend(part["h"].to_pylist())
                held += weight
                if held >= GATHERED:
                    yield from _pack(sets, ids, keys, fragments)
                    sets, ids, keys, held = [], [], [], 0
        if sets:
            yield from _pack(sets, ids, keys, fragments)

    return run


def _count_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch of documents, how many n-grams of each are elsewhere too (kind 1, int32s)."""
    held: list[tuple[bytes, int, bytes]] = []
    for batch in batches:
        kind = batch["kind"].to_numpy(zero_copy_only=False)
        if (kind == 0).any():
            yield batch.filter(pa.array(kind == 0))
        part = batch.filter(pa.array(kind == 1))
        held.extend(
            zip(part["batch"].to_pylist(), part["fragment"].to_pylist(), part["data"].to_pylist(), strict=True)
        )
    for fragment in sorted({f for _, f, _ in held}):
        mine = [(b, np.frombuffer(d, np.uint32)) for b, f, d in held if f == fragment]
        once, docs, twice = [], [], []
        for _, x in mine:
            pairs = int(x[0])
            who = np.repeat(x[1 : 1 + pairs], x[1 + pairs : 1 + 2 * pairs])
            docs.append(who)
            once.append(x[1 + 2 * pairs : 1 + 2 * pairs + len(who)])
            twice.append(x[1 + 2 * pairs + len(who) :])
        low = np.concatenate(once)
        everything = np.concatenate([low, *twice, *twice])
        order = np.argsort(everything, kind="stable")
        ranked = everything[order]
        again = np.zeros(len(ranked), bool)
        again[1:] = ranked[1:] == ranked[:-1]
        again[:-1] |= ranked[1:] == ranked[:-1]
        shared = np.zeros(len(everything), bool)
        shared[order] = again
        at, names, data = 0, [], []
        for (name, _), d in zip(mine, docs, strict=True):
            hit = d[shared[at : at + len(d)]]
            at += len(d)
            if len(hit):
                who, n = np.unique(hit, return_counts=True)
                names.append(name)
                data.append(np.concatenate([who.astype(np.int32), n.astype(np.int32)]).tobytes())
        if names:
            none = [None] * len(names)
            yield pa.record_batch(
                [pa.array([1] * len(names), pa.int8()), pa.array(names, pa.binary()),
                 pa.array([fragment] * len(names), pa.int64()), *[pa.array(none, pa.int64())] * 3,
                 pa.array(none, pa.binary()), pa.array(data, pa.binary())],
                schema=_schema(),
            )


def _sum_batch(table: pa.Table) -> pa.Table:
    """Sum the fragments' counts over one batch of documents."""
    kind = table["kind"].to_numpy()
    docs = table.filter(pa.array(kind == 0))
    mine = [np.frombuffer(x, np.int64) for x in docs["data"].to_pylist()]
    index = np.array([x[0] for x in mine], np.int64)
    shared = np.zeros(index.max() + 1 if len(index) else 0, np.int64)
    shared[index] = [x[1] for x in mine]
    for data in table.filter(pa.array(kind == 1))["data"].to_pylist():
        x = np.frombuffer(data, np.int32)
        shared[x[: len(x) // 2]] += x[len(x) // 2 :]
    return pa.table(
        [docs["doc_id"], docs["h"], docs["n"], docs["digest"], pa.array(shared[index])],
        names=["doc_id", "h", "n", "digest", "shared"],
    )


def shared_counts(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, h, n, digest, shared`` of every row of ``docs(doc_id, h, text)``.

    ``h`` tells rows of one id apart; ``n`` is the size of the set, ``digest`` stands for it (null for
    the empty set), ``shared`` is how many of its n-grams another row has as well.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(shuffle_partitions(docs.sparkSession), -(-total // FRAGMENT))
    packed = docs.select("doc_id", "h", "text").mapInArrow(_fragments_of(size, fragments), _PACKED)
    dealt = packed.repartitionById(fragments, F.col("fragment").cast("int"))
    counted = dealt.mapInArrow(_count_fragment, _PACKED)
    return materialize(counted.groupBy("batch").applyInArrow(_sum_batch, _COUNTED), "ngram-counts")


def _segments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - (PAIR_FRAGMENTS.bit_length() - 1))
        for batch in batches:
            ids, ns, frags, grams = [], [], [], []
            numbers, digests = batch["set_id"].to_pylist(), batch["digest"].to_pylist()
            for number, wanted, s in zip(numbers, digests, sets_of(batch["text"], size), strict=True):
                if not len(s) or set_digest(s) != wanted:  # another row of the same id
                    continue
                cuts = np.searchsorted(s >> shift, np.arange(PAIR_FRAGMENTS + 1))
                for k in range(PAIR_FRAGMENTS):
                    if cuts[k] < cuts[k + 1]:
                        ids.append(number)
                        ns.append(len(s))
                        frags.append(k)
                        grams.append(s[cuts[k] : cuts[k + 1]].view(np.int64))
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(frags, pa.int32()),
                 pa.array(grams, pa.list_(pa.int64()))],
                names=["set_id", "n", "fragment", "grams"],
            )

    return run


def _can_link(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _reaches(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return (100 * overlap) >= (percent * (n + m - overlap))


def prefixes(segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``gram, set_id, n, alone, pos`` of the prefix n-grams that several sets have, rarest first.

    ``pos`` is the place in the set's whole order. N-grams of one set only come first there; they
    are part of the prefix but meet nobody.
    """
    grams = segments.select("set_id", F.explode("grams").alias("gram"))
    sizes = segments.groupBy("set_id").agg(F.first("n").alias("n"))
    frequent = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ordered = (
        grams.join(frequent, "gram")
        .groupBy("set_id")
        .agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("held"))
        .join(sizes, "set_id")
    )
    alone = F.col("n") - F.size("held")
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    ordered = ordered.withColumn("alone", alone).where(length > alone)
    ordered = ordered.withColumn("held", F.slice("held", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")))
    return ordered.select("set_id", "n", "alone", F.posexplode("held").alias("k", "g")).select(
        F.col("g.gram").alias("gram"), "set_id", "n", "alone", (F.col("alone") + F.col("k")).alias("pos")
    )


def overlapping(pairs: DataFrame, segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs(a, b)`` of sets that link: partial overlaps by fragment, summed for each pair."""
    left = segments.select(F.col("set_id").alias("a"), F.col("n").alias("an"), "fragment", F.col("grams").alias("ag"))
    right = segments.select(F.col("set_id").alias("b"), F.col("n").alias("bn"), "fragment", F.col("grams").alias("bg"))
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
    counted = partial.select("a", "b", "an", "bn", F.size(F.array_intersect("ag", "bg")).alias("common"))
    total = counted.groupBy("a", "b", "an", "bn").agg(F.sum("common").alias("common"))
    return total.where(_reaches(F.col("common"), F.col("an"), F.col("bn"), percent)).select("a", "b")


def _fits(one: str, two: str, percent: int) -> Column:
    """Both sizes and what can still follow this n-gram allow a link, if it is the first in common."""
    n, m = F.col(f"{one}.n"), F.col(f"{two}.n")
    rest = 1 + F.least(n - F.col(f"{one}.pos") - 1, m - F.col(f"{two}.pos") - 1)
    return _can_link(n, m, percent) & _reaches(rest, n, m, percent)


def _with_parts(prefix: DataFrame, links: DataFrame) -> DataFrame:
    """The n-grams whose holders are not all joined yet; each holder with its component ``part``."""
    found = components(links).withColumnRenamed("node", "set_id")
    parts = prefix.join(found, "set_id", "left").withColumn("part", F.coalesce("root", "set_id"))
    parts = materialize(parts.drop("root"), "ngram-parts")
    mixed = parts.groupBy("gram").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    return parts.join(mixed.select("gram"), "gram")


def _hubs(holders: DataFrame) -> DataFrame:
    """Of each n-gram's holders the one with the fewest n-grams of its own: the likeliest original."""
    hub = holders.groupBy("gram").agg(F.min(F.struct("alone", "set_id", "n", "pos", "part")).alias("hub"))
    return hub.select("gram", "hub.*")


def _pairs(x: DataFrame, y: DataFrame, different: Column, percent: int) -> DataFrame:
    near = x.alias("x").join(y.alias("y"), "gram").where(different).where(_fits("x", "y", percent))
    one, two = F.col("x.set_id"), F.col("y.set_id")
    return near.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).distinct()


def prefix_arrays(prefix: DataFrame) -> DataFrame:
    """``set_id, n, grams``: the prefix n-grams of each set that others have."""
    return prefix.groupBy("set_id", "n").agg(F.collect_list("gram").alias("grams"))


def _can_reach(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` that can still link, by all the prefix n-grams that they share.

    Of two sets, the one whose prefix ends first in the global order has every other common n-gram
    behind its prefix: the overlap is at most the prefixes' common n-grams and the rest of that set.
    """
    one, two = held.toDF("a", "n", "ag"), held.toDF("b", "m", "bg")
    both = pairs.join(one, "a").join(two, "b")
    behind = F.greatest(*[F.ceil(F.lit(percent) * F.col(v) / 100) - 1 for v in ("n", "m")])
    most = F.size(F.array_intersect("ag", "bg")) + behind
    return both.where(_reaches(most, F.col("n"), F.col("m"), percent)).select("a", "b")


def linked_sets(segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between distinct sets that give the components of all links.

    Holders of an n-gram meet its hub, then a second hub outside the first one's component, and
    then all pairs that are still of different components. Of each step's pairs only those are counted
    that can reach the threshold by all the n-grams that their prefixes share.
    """
    prefix = materialize(prefixes(segments, percent).withColumn("part", F.col("set_id")), "ngram-prefixes")
    held = materialize(prefix_arrays(prefix), "ngram-held")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(overlapping(_can_reach(pairs, held, percent), segments, percent), "ngram-links")

    apart = F.col("x.part") != F.col("y.part")
    hub = _hubs(prefix)
    links = linked(_pairs(prefix, hub, apart, percent))
    open_ = _with_parts(prefix.drop("part"), links)
    first = open_.join(hub.select("gram", "set_id"), ["gram", "set_id"]).select("gram", F.col("part").alias("of_hub"))
    second = _hubs(open_.join(first, "gram").where("part <> of_hub"))
    links = links.unionByName(linked(_pairs(open_, second, apart, percent)))
    open_ = _with_parts(prefix.drop("part"), links)
    return links.unionByName(linked(_pairs(open_, open_, F.col("x.part") > F.col("y.part"), percent)))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, h`` of every row of ``docs(doc_id, text)``, see ``represented``."""
    return represented(docs, size, percent).drop("is_first")


def represented(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, h, is_first`` of every row of ``docs(doc_id, text)``.

    Two rows link when ``100 * |intersection| >= percent * |union|``. ``component_id`` is the
    smallest ``doc_id`` of all rows that links lead to. A null text, or one without words, has no
    n-grams and its own id; ``h`` is a hash of the text, which tells rows of one id apart; fewer than ``size`` words are one n-gram. Null ids are kept and take
    part in links. Rows with equal sets are one set from the start, however many they are.
    ``is_first`` holds for one ``(doc_id, h)`` of each component, the smallest with null ids last.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    counted = shared_counts(docs, size)
    may_link = (F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n"))
    able = counted.where(may_link)
    one = able.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("one"))
    # a number takes the place of the digest from here on; the written table fixes it
    one = one.select(
        F.monotonically_increasing_id().alias("set_id"), "digest", F.col("one.doc_id").alias("one_id"),
        F.col("one.h").alias("one_h"),
    )
    one = materialize(one, "ngram-sets")
    texts = docs.join(one, (F.col("h") == F.col("one_h")) & F.col("doc_id").eqNullSafe(F.col("one_id")))
    cut = texts.select("set_id", "digest", "text").mapInArrow(_segments(size), _SEGMENT)
    repeated = able.groupBy("doc_id", "h").agg(F.count("*").alias("m")).where("m > 1")
    if not repeated.isEmpty():  # rows equal in id and text have each read the same set
        cut = cut.dropDuplicates(["set_id", "fragment"])
    segments = materialize(cut, "ngram-segments")
    root = components(linked_sets(segments, percent)).withColumnRenamed("node", "set_id")
    part = one.join(root, "set_id", "left").select("digest", F.coalesce("root", "set_id").alias("part"))
    named = materialize(able.join(part, "digest").select("doc_id", "h", "n", "part"), "ngram-named")
    least = named.groupBy("part").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("m"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("rep"),
    )
    least = materialize(least.where("m > 1"), "ngram-components")
    linked = named.join(least, "part", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    is_first = (F.col("rep.h") == F.col("h")) & F.col("rep.doc_id").eqNullSafe(F.col("doc_id"))
    linked = linked.withColumn("is_first", F.col("rep").isNull() | is_first)
    # the others have no equal either: they are components of their own, and meet no join
    alone = counted.where(~may_link).withColumn("component_id", F.col("doc_id")).withColumn("is_first", F.lit(True))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "h", "is_first"]
    return linked.select(columns).unionByName(alone.select(columns))
