"""A prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns, known by its depth and a 128-bit fingerprint: the XOR of
hashes of each turn with its place, so that the fingerprints of a conversation of any length are
running XORs and need no task of its own. A node belongs to its smallest member; the nodes of a
conversation are the end of its path. Totals of subtrees go up in bands of ``band`` depths: within a
band a conversation adds its nodes to the ancestors on its own path there, at most one row for each; the
tops of the bands are a smaller trie of the same form, completed in the same way; then every completed
top is added to its ancestors in the band above. Rounds grow with the logarithm of the depth.

Rows without a conversation id belong to no conversation. Null roles and texts are empty. Turns go by
number, null first, then by role and text; repeated rows are turns of their own. Further columns are
ignored. Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.llm.common import materialize, shuffle_partitions

#: Depths of a band.
BAND = 32
#: Every conversation takes its first turns from the one whose id ends its hundred.
HUNDRED = 100
#: It takes fewer turns than this.
MOST_TAKEN = 6
#: Ids in a chunk of an ending's list.
CHUNK = 4096

_PLACED = "conv_id long, piece int, place long, g1 long, g2 long, chars long"
_CHUNKS = "depth long, k1 long, k2 long, first long, ids string"
_ENDINGS = "depth long, k1 long, k2 long, ends_sha256 string"
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the sorted turns of a partition within each conversation, and digest what they say."""
    piece, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch["conv_id"].to_numpy()
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        run = np.cumsum(new) - 1
        place = np.arange(n) - np.flatnonzero(new)[run] + 1
        if conv[0] == last:
            place[run == 0] += count
        last, count = conv[-1], int(place[-1])
        roles, texts = batch["role"].to_pylist(), batch["text"].to_pylist()
        said = (f"{len(r)} {r}{t}".encode() for r, t in zip(roles, texts, strict=True))
        digests = b"".join(hashlib.blake2b(s, digest_size=16).digest() for s in said)
        g = np.frombuffer(digests, "<i8").reshape(n, 2)
        columns = (
            batch["conv_id"], np.full(n, piece, np.int32), place, np.ascontiguousarray(g[:, 0]),
            np.ascontiguousarray(g[:, 1]), np.fromiter(map(len, texts), np.int64, n),
        )
        yield pa.record_batch([pa.array(c) for c in columns], names=[f.split()[0] for f in _PLACED.split(", ")])


def placed_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, piece, place, g1, g2, chars`` of every turn: texts move once, and only digests are kept.

    All turns are range-partitioned by conversation and order, so a long conversation is several
    pieces. The pieces are written, since their cuts come from a sample.
    """
    empty = F.lit("")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(_place, _PLACED), "trie-turns")


def taken() -> F.Column:
    """How many first turns ``conv_id`` takes over, where there are as many."""
    return F.crc32(F.col("conv_id").cast("string")) % MOST_TAKEN


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, length`` and their turns ``conv_id, depth, g1, g2, chars`` when rebuilt.

    What is known of a conversation goes to its turns piece by piece.
    """
    line = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = placed.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    pieces = materialize(pieces.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))), "trie-pieces")
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("m"))
    convs = convs.withColumn("h", taken()).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("m").alias("b"))
    convs = convs.join(bases, "base", "left")
    convs = convs.withColumn("took", F.least("h", F.coalesce("b", F.lit(0))))
    convs = convs.withColumn("length", F.col("took") + F.greatest(F.col("m") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "took", "length"), "trie-conversations")
    known = pieces.select("conv_id", "piece", "before").join(convs.select("conv_id", "h", "took"), "conv_id")
    ranked = placed.join(known, ["conv_id", "piece"]).withColumn("rank", F.col("place") + F.col("before"))
    said = ["g1", "g2", "chars"]
    own = ranked.where(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("took")).alias("depth"), *said)
    firsts = ranked.where((F.col("conv_id") % HUNDRED == 0) & (F.col("rank") < MOST_TAKEN))
    firsts = firsts.select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), *said)
    depths = F.sequence(F.lit(1).cast("long"), F.col("took"))
    wanted = convs.where("took > 0").select("conv_id", "base", F.explode(depths).alias("depth"))
    shared = wanted.join(firsts, ["base", "depth"]).select("conv_id", "depth", *said)
    return convs.select("conv_id", "length"), own.unionByName(shared)


def _running_before(totals: DataFrame, highest: int, band: int) -> DataFrame:
    """``totals(conv_id, at, f1, f2)`` with the XOR of all smaller ``at`` of the conversation instead.

    No window holds more than ``band`` rows.
    """
    rows = totals.withColumn("block", F.floor(F.col("at") / band))
    line = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f: F.coalesce(F.bit_xor(f).over(line), F.lit(0)) for f in ("f1", "f2")})
    if highest < band:
        return inside.drop("block")
    upper = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f).alias(f) for f in ("f1", "f2")])
    upper = _running_before(upper.withColumnRenamed("block", "at"), highest // band, band)
    joined = inside.join(upper.toDF("conv_id", "block", "u1", "u2"), ["conv_id", "block"])
    return joined.select(
        "conv_id", "at", *[F.col(f"f{k}").bitwiseXOR(F.col(f"u{k}")).alias(f"f{k}") for k in (1, 2)]
    )


def paths(convs: DataFrame, turns: DataFrame, highest: int, band: int) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, chars, last`` from depth 0 on: the fingerprints of each prefix
    and of its parent, and whether the conversation ends there."""
    salted = turns.select(
        "conv_id", "depth", "chars", F.floor((F.col("depth") - 1) / band).alias("at"),
        F.xxhash64("depth", "g1", "g2").alias("f1"), F.xxhash64("g2", "g1", "depth", F.lit(1)).alias("f2"),
    )
    totals = salted.groupBy("conv_id", "at").agg(*[F.bit_xor(f).alias(f) for f in ("f1", "f2")])
    before = _running_before(totals, max(highest - 1, 0) // band, band)
    before = before.toDF("conv_id", "at", "b1", "b2").join(convs, "conv_id")
    line = Window.partitionBy("conv_id", "at").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = salted.withColumns({f"w{k}": F.bit_xor(f"f{k}").over(line) for k in (1, 2)})
    joined = inside.join(before, ["conv_id", "at"])
    key = {k: F.col(f"w{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)}
    rows = joined.select(
        "conv_id", "depth",
        *[key[k].alias(f"k{k}") for k in key],
        *[key[k].bitwiseXOR(F.col(f"f{k}")).alias(f"p{k}") for k in key],
        "chars", (F.col("depth") == F.col("length")).alias("last"),
    )
    zero = F.lit(0).cast("long")
    top = convs.select(
        "conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("k1", "k2", "p1", "p2", "chars")],
        (F.col("length") == 0).alias("last"),
    )
    return rows.unionByName(top)


def rollup(rows: DataFrame, highest: int, band: int) -> DataFrame:
    """``depth, k1, k2, leaves, saved``: the totals over each node's subtree.

    ``rows(conv_id, depth, k1, k2, own, leaves, saved)`` are the paths of conversations; a node's value
    stands at the row of the conversation that it belongs to (``own``), elsewhere it is 0.
    """
    sums = ("leaves", "saved")
    rows = rows.withColumn("_band", F.floor(F.col("depth") / band))
    line = Window.partitionBy("conv_id", "_band").orderBy(F.desc("depth"))
    line = line.rowsBetween(Window.unboundedPreceding, 0)
    up = rows.withColumns({s: F.sum(s).over(line) for s in sums}).where("leaves <> 0 OR saved <> 0")
    within = up.groupBy(*NODE).agg(*[F.sum(s).alias(s) for s in sums])
    if highest < band:
        return within
    within = materialize(within, "trie-bands")
    tops = rows.where(F.col("depth") % band == 0).drop(*sums)
    of_top = within.where(F.col("depth") % band == 0)
    tops = tops.join(of_top.withColumn("own", F.lit(True)), [*NODE, "own"], "left")
    tops = tops.fillna(0, list(sums)).withColumn("depth", F.floor(F.col("depth") / band)).drop("_band")
    tops = materialize(tops, "trie-tops")
    done = rollup(tops, highest // band, band).where("depth > 0")
    owners = tops.where("own").select("conv_id", *NODE)
    given = owners.join(done, NODE).select("conv_id", (F.col("depth") - 1).alias("_band"), *sums)
    above = rows.drop(*sums).join(given, ["conv_id", "_band"]).select(*NODE, *sums)
    return within.unionByName(above).groupBy(*NODE).agg(*[F.sum(s).alias(s) for s in sums])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the ids of each node's endings, up to ``CHUNK`` of them at a time."""
    node, first, ids = None, 0, []
    done: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 5
        done.clear()
        kinds = (*[pa.int64()] * 4, pa.string())
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*NODE, "first", "ids"]
        )

    for batch in batches:
        for *key, conv in zip(*(batch[c].to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if key != node or len(ids) == CHUNK:
                if ids:
                    done.append((*node, first, ",".join(ids)))
                node, first, ids = key, conv, []
            ids.append(str(conv))
        yield batch_of()
    if ids:
        done.append((*node, first, ",".join(ids)))
        yield batch_of()


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of each node, one after another."""
    node, state, done = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch[c].to_pylist() for c in (*NODE, "ids")), strict=True):
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(ids.encode())
        columns = list(zip(*done, strict=True)) or [()] * 4
        done = []
        yield _endings(columns)
    if node is not None:
        yield _endings([(v,) for v in (*node, state.hexdigest())])


def _endings(columns: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 3, pa.string())
    return pa.record_batch(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*NODE, "ends_sha256"]
    )


def endings(rows: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of the nodes where conversations end.

    Ids are sorted and joined in chunks wherever they lie; a node's task reads chunks, not ids.
    """
    ends = rows.where("last").select(*NODE, "conv_id")
    key = [*NODE, "conv_id"]
    chunks = ends.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_chunks, _CHUNKS)
    dealt = chunks.repartition(shuffle_partitions(rows.sparkSession), *NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_hash_chunks, _ENDINGS)


def prefix_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of ``turns(conv_id, turn, role, text)``.

    Conversation c takes the first h turns of conversation ``c - c % 100`` and then its own after its
    first h, with ``h = crc32(c) % 6``. ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, ``(n_convs - 1)`` times the code
    points of each node's last text) and ``ends_sha256`` (of the joined ids that end there).
    """
    convs, said = rebuilt(placed_turns(turns))
    highest = convs.agg(F.max("length")).first()[0] or 0
    rows = materialize(paths(convs, said, highest, band), "trie-paths")
    nodes = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        *[F.min(c).alias(c) for c in ("p1", "p2", "chars")],
    )
    nodes = materialize(nodes, "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    nodes = materialize(nodes, "trie-families")
    values = nodes.select(
        "conv_id", *NODE, F.lit(True).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    valued = rows.select("conv_id", *NODE).join(values, ["conv_id", *NODE], "left")
    valued = valued.fillna(0, ["leaves", "saved"]).withColumn("own", F.coalesce("own", F.lit(False)))
    totals = rollup(materialize(valued, "trie-values"), highest, band)
    # one row for each node that has children; a node with very many is a join that Spark splits
    names = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    out = materialize(nodes.join(names, ["depth", "p1", "p2"], "left"), "trie-named")
    out = out.join(totals, NODE, "left").join(endings(rows), NODE, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
