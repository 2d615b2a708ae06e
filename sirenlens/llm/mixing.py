"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / size of the
source. Its integral part is given; the fractional parts are rounded in pairs: mass (probability
times words) moves at random from one document to the other until one of them is integral, with
the odds that keep both expectations. The words of a source are thereby kept exactly up to one
document. Leaves of a bounded number of documents are rounded side by side; the one document that
each leaves fractional goes up a reduction tree with a bounded fan-in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sirenlens.llm.common import materialize

#: Documents of a leaf and children of an inner node of the tree.
FAN_IN = 1000
NODE = (
    "doc_id long, source string, key long, size long, source_size long, target double, whole long, "
    "p double, chunk long, copies long"
)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``source, source_size, target, docs`` from ``sizes(source, size)``, one row for each source.

    Sources in code point order, null last, take the weights in turn and share ``budget`` times all
    words. A target stops at ``most`` times its source; the excess goes to the others by weight.
    That fixed point is a common level: with the sources by cap / weight, those before the level are
    at their caps. Windows run over one row for each source, never over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    every = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = order.rowsBetween(W.unboundedPreceding, -1)
    above = order.rowsBetween(0, W.unboundedFollowing)
    total = F.lit(budget) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(above)
    capped = ranked.withColumn("total", total).withColumn("at_cap", F.col("cap") <= F.col("weight") * level)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("at_cap"), F.col("cap"))).over(every), F.lit(0.0))
    shared = F.sum(F.when(~F.col("at_cap"), F.col("weight"))).over(every)
    target = F.when(F.col("at_cap"), F.col("cap")).otherwise(F.col("weight") * left / shared)
    return capped.withColumn("target", target).select("source", "source_size", "target", "docs")


def pair_off(size: Sequence[int], p: Sequence[float], u: Sequence[float]) -> tuple[list[int], int, float]:
    """Round all but one: the results (0 or 1, -1 for the one left), which is left (-1: none), its p."""
    done = [-1] * len(size)
    at, a = -1, 0.0
    for j in range(len(size)):
        if at < 0:
            at, a = j, p[j]
            continue
        b, s, t = p[j], size[at], size[j]
        to_full, to_empty = (1 - a) * s, b * t  # what moves if j gives to at
        up = min(to_full, to_empty)
        at_empty, j_full = a * s, (1 - b) * t  # what moves if at gives to j
        down = min(at_empty, j_full)
        if u[j] * (up + down) < down:
            a, b = (1.0 if up == to_full else a + up / s), (0.0 if up == to_empty else b - up / t)
        else:
            a, b = (0.0 if down == at_empty else a - down / s), (1.0 if down == j_full else b + down / t)
        if a in (0.0, 1.0):
            done[at] = int(a)
            at, a = -1, 0.0
            if b in (0.0, 1.0):
                done[j] = int(b)
            else:
                at, a = j, b
        else:
            done[j] = int(b)
    return done, at, a


def _uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) from a row's own key: a task that runs again draws the same."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of a 64-bit number decides every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odds(group: pd.DataFrame, seed: int) -> list[float]:
    """A number in [0, 1) for each row, independent of the order of the rows and of other levels.

    Equal rows get different numbers, by their turn: which of them gets which makes no difference.
    """
    turn = group.groupby(["key", "doc_id"], dropna=False).cumcount().to_numpy(np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    start = _mixed(np.full(len(group), seed, np.uint64) * step + turn)
    key = group["key"].to_numpy(np.int64).view(np.uint64)
    drawn = _mixed(_mixed(key + start) + step)
    return ((drawn >> np.uint64(11)) / float(1 << 53)).tolist()


def _node(last: bool, seed: int = 0):
    """Rows go in the order of ``draw``; a second, independent number decides which way mass moves."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["draw", "key", "doc_id"], kind="stable")
        done, at, a = pair_off(group["size"].tolist(), group["p"].tolist(), _odds(group, seed))
        if at >= 0 and last:
            done[at] = int(group["lot"].iloc[at] < a)
        whole = group["whole"].to_numpy()
        copies = [None if d < 0 else int(w) + d for w, d in zip(whole, done, strict=True)]
        p = group["p"].tolist()
        if at >= 0:
            p[at] = a
        out = group.drop(columns=["draw", "lot"])
        return out.assign(p=p, copies=pd.array(copies, "Int64"))

    return run


def mix_to_targets(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
    seed: int = 20_011,
) -> DataFrame:
    """``doc_id, source, key, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``docs`` has ``doc_id, source, text``. A null or blank text has size 0 and takes nothing. Rows
    are told apart by ``key``, a hash of id, source and text; equal rows are rounded like any others.
    No document gets more than ``ceil(most)`` copies, so at most ``most`` times its size where that
    is whole. No text is moved. Reruns give the same copies.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
        word_count(F.col("text")).alias("size"),
    )
    sized = materialize(sized, "mix-sizes")
    targets = materialize(source_targets(sized, weights, budget, most), "mix-targets")
    of = targets.withColumnRenamed("source", "_source")
    rows = sized.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(expected).cast("long")).withColumn("p", expected - F.col("whole"))
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    leaf = F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("docs") / FAN_IN).cast("long"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    settled = rows.where(~open_).withColumn("chunk", F.lit(0).cast("long")).withColumn("copies", F.col("whole"))
    parts = [settled.select(columns)]
    todo = rows.where(open_).withColumn("chunk", leaf).withColumn("copies", F.lit(None).cast("long"))
    most_docs = targets.agg(F.max("docs")).first()[0] or 0
    nodes, level = max(1, math.ceil(most_docs / FAN_IN)), 0
    while True:
        last = nodes == 1
        drawn = todo.withColumn("draw", _uniform(seed + 2 * level + 1, "key"))
        drawn = drawn.withColumn("lot", _uniform(seed + 2 * level + 2, "key")).select(*columns, "draw", "lot")
        done = drawn.groupBy("source", "chunk").applyInPandas(_node(last, seed + level), NODE)
        done = materialize(done, f"mix-level-{level}")
        parts.append(done.where("copies is not null"))
        if last:
            break
        todo = done.where("copies is null").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        nodes, level = math.ceil(nodes / FAN_IN), level + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(
        "doc_id", "source", "key", "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
