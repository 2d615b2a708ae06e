"""Firing episodes per identity.

One identity may hold a large share of all rows, so no window ever spans an identity's whole
history. Rows collapse to instants; instants are scanned inside fixed time slices; the slices
of an identity (at most a week of them) are then stitched. Every step is exact, and the work
of one task is bounded by a slice, not by an identity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.sources.schema import IDENTITY

c = F.col
SLICE_US = K.HOUR_US


def is_clear() -> Column:
    """v1 clears by severity, v2 by status."""
    v1 = c("alert_schema") == "v1"
    return F.coalesce(
        F.when(v1, c("severity") == "clear").otherwise(c("status") == "resolved"), F.lit(False)
    )


def slice_of(us: Column) -> Column:
    return F.floor(us / SLICE_US).cast("long")


def instants(rows: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Firing and clearing rows per identity and instant (fires precede clears in one instant)."""
    return instants_of(rows.withColumn("clear", is_clear()), keys)


def instants_of(rows: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """The instants of rows that are known to ``clear`` or to fire."""
    us = rows.withColumn("us", F.unix_micros("ts"))
    return (
        us.groupBy(*keys, "us")
        .agg(
            F.count_if(~c("clear")).alias("fires"),
            F.count_if(c("clear")).alias("clears"),
        )
        .withColumn("slice", slice_of(c("us")))
    )


def scan_slices(points: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Instants with their episode number inside the slice and whether they end a cycle.

    ``cycle`` is NULL only where the answer depends on the previous slice: a slice that opens
    with a pure clear.
    """
    # a number first: rows are sorted by it before any text is compared
    order = Window.partitionBy("slice", *reversed(keys)).orderBy("us")
    closes = c("clears") > 0
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    previous_open = F.lag(~closes).over(order)
    return points.withColumn(
        "episode", F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0))
    ).withColumn(
        "cycle",
        F.when(~closes, F.lit(False)).when(c("fires") > 0, F.lit(True)).otherwise(previous_open),
    )


def summarize_slices(scanned: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """One row per identity and slice. Straight from the scan it is partitioned alike, so no further shuffle."""
    fired = F.when(c("fires") > 0, c("us"))
    episodes = scanned.groupBy(*keys, "slice", "episode").agg(
        F.sum("fires").alias("fires"),
        F.sum("clears").alias("clears"),
        F.min(fired).alias("fire_us"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.max(c("clears") > 0).alias("closed"),
        F.min_by("cycle", "us").alias("first_cycle"),
        F.min_by(c("clears") > 0, "us").alias("starts_clear"),
    )
    head, tail = c("episode") == 0, ~c("closed")
    return episodes.groupBy(*keys, "slice").agg(
        F.sum("fires").alias("fires"),
        F.sum("clears").alias("clears"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max("closed").alias("closed"),
        F.sum(F.when(head, c("fires"))).alias("head_fires"),
        F.min(F.when(head, c("fire_us"))).alias("head_us"),
        F.sum(F.when(tail, c("fires"))).alias("tail_fires"),
        F.min(F.when(tail, c("fire_us"))).alias("tail_us"),
        F.max(F.when(~head & c("closed"), c("fires"))).alias("inner_fires"),
        # the slice's first instant is a clear nothing inside the slice explains
        F.max(head & c("starts_clear") & c("first_cycle").isNull()).alias("edge_clear"),
    )


def stitch(slices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return slices.withColumn(
        "group", F.coalesce(F.sum(c("closed").cast("int")).over(before), F.lit(0))
    ).withColumn("carried_open", F.lag(c("tail_fires").isNotNull()).over(order))


def episode_totals(stitched: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per identity: totals, the largest episode and the open episode's start.

    A slice without a clear extends the running episode; a slice with one ends it and may start
    the next.
    """
    parts = F.array(
        F.struct(
            c("group").alias("g"), c("head_fires").alias("f"), c("head_us").alias("at")
        ),
        F.struct(
            (c("group") + 1).alias("g"),
            F.when(c("closed"), c("tail_fires")).alias("f"),
            F.when(c("closed"), c("tail_us")).alias("at"),
        ),
    )
    pieces = stitched.select(*keys, F.inline(parts)).where(c("f").isNotNull())
    merged = pieces.groupBy(*keys, "g").agg(F.sum("f").alias("f"), F.min("at").alias("at"))
    spanning = merged.groupBy(*keys).agg(
        F.max("f").alias("spanning_fires"),
        F.max_by(F.struct("f", "at"), "g").alias("last"),
        F.max("g").alias("last_group"),
    )
    totals = stitched.groupBy(*keys).agg(
        F.sum(c("fires") + c("clears")).alias("row_count"),
        F.sum("clears").alias("clear_count"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
        F.max("inner_fires").alias("inner_fires"),
        F.sum(c("closed").cast("int")).alias("closed_slices"),
    )
    open_us = F.when(
        (c("last_group") == c("closed_slices")) & (c("last.f") > 0), c("last.at")
    )
    return totals.join(spanning, list(keys), "left").select(
        *keys,
        "row_count",
        "clear_count",
        "first_us",
        "last_us",
        F.greatest(
            F.coalesce("spanning_fires", F.lit(0)), F.coalesce("inner_fires", F.lit(0))
        ).alias("max_episode_firing_rows"),
        open_us.alias("open_us"),
    )


def cycle_instants(
    local: DataFrame, stitched: DataFrame, keys: tuple[str, ...] = IDENTITY
) -> DataFrame:
    """Instants that end a fire-to-clear cycle: the ones a slice knows itself (``local``) and
    the ones whose firing came from an earlier slice."""
    edge = stitched.where(c("edge_clear") & c("carried_open")).select(
        *keys, c("first_us").alias("us")
    )
    return local.select(*keys, "us").union(edge)


def max_cycles(cycles: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Most cycles inside any rolling, half-open 24 hours.

    Each cycle counts from its instant until 24 hours later (an expiry comes first at a tie);
    the running count is taken per slice and carried across slices as a prefix sum.
    """
    steps = cycles.select(
        *keys,
        F.inline(
            F.array(
                F.struct(c("us"), F.lit(1).alias("step")),
                F.struct((c("us") + K.FLAP_WINDOW_US).alias("us"), F.lit(-1).alias("step")),
            )
        ),
    ).withColumn("slice", slice_of(c("us")))
    inside = Window.partitionBy("slice", *reversed(keys)).orderBy("us", "step")
    running = F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    per_slice = (
        steps.withColumn("running", running)
        .groupBy(*keys, "slice")
        .agg(F.sum("step").alias("net"), F.max("running").alias("peak"))
    )
    across = Window.partitionBy(*keys).orderBy("slice")
    carried = F.coalesce(
        F.sum("net").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        per_slice.withColumn("level", carried + c("peak"))
        .groupBy(*keys)
        .agg(F.max("level").alias("max_clear_cycles_24h"))
    )


def firing_from_slices(
    slices: DataFrame, local_cycles: DataFrame, keys: tuple[str, ...] = IDENTITY
) -> DataFrame:
    """Stitch slice summaries, from a batch scan or a stream, into facts per identity."""
    stitched = stitch(slices, keys)
    facts = episode_totals(stitched, keys)
    cycles = max_cycles(cycle_instants(local_cycles, stitched, keys), keys)
    return with_spans(facts.join(cycles, list(keys), "left"))


def firing_facts(rows: DataFrame, keys: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Episode facts of every identity, before the pattern is judged."""
    return firing_of_instants(instants(rows, keys), keys)


def firing_of_instants(
    points: DataFrame, keys: tuple[str, ...] = IDENTITY, keep: Callable[[DataFrame, str], DataFrame] | None = None
) -> DataFrame:
    """Facts per identity. ``keep`` writes a table that several steps read: the scanned instants and
    the slices, which would be grouped, sorted and scanned anew for each of them."""
    kept = keep or (lambda df, name: df)
    scanned = kept(scan_slices(points, keys), "scanned")
    slices = kept(summarize_slices(scanned, keys), "slices")
    return firing_from_slices(slices, scanned.where(c("cycle")), keys)


def with_spans(facts: DataFrame) -> DataFrame:
    span = c("last_us") - c("first_us")
    return (
        facts.withColumn("max_clear_cycles_24h", F.coalesce("max_clear_cycles_24h", F.lit(0)))
        .withColumn("span_us", span)
        .withColumn("open_span_us", c("last_us") - c("open_us"))
        .withColumn(
            "events_per_24h",
            F.when(
                c("span_us") >= K.SPAM_MIN_SPAN_US,
                c("row_count").cast("double") / (c("span_us") / float(K.DAY_US)),
            ),
        )
    )


def fire_pattern(provider: Column) -> Column:
    """flapping, then spamming (not Grafana), then stuck (Grafana). Integer comparisons only."""
    grafana = F.coalesce(provider == "grafana", F.lit(False))
    # rows * 24h >= 24 * span, kept inside 64 bits
    needed = F.ceil((c("span_us") * K.SPAM_PER_DAY).cast("decimal(38,0)") / K.DAY_US)
    return (
        F.when(c("max_clear_cycles_24h") >= K.FLAP_CYCLES, "flapping")
        .when(
            ~grafana & (c("span_us") >= K.SPAM_MIN_SPAN_US) & (c("row_count") >= needed),
            "spamming",
        )
        .when(grafana & F.coalesce(c("open_span_us") >= K.STUCK_OPEN_US, F.lit(False)), "stuck")
    )


def _hours(us: Column) -> Column:
    """Hours to two digits, half-even on the exact quotient."""
    return F.bround(us.cast("decimal(38,0)") / K.HOUR_US, 2).cast("double")


def pattern_evidence() -> Column:
    """R6 evidence, as JSON text."""
    return F.to_json(
        F.struct(
            c("fire_pattern").alias("pattern"),
            c("row_count").alias("rows"),
            "clear_count",
            "max_clear_cycles_24h",
            "max_episode_firing_rows",
            _hours(c("open_span_us")).alias("open_hours"),
            _hours(c("span_us")).alias("span_hours"),
            F.bround("events_per_24h", 2).alias("events_per_24h"),
        ),
        {"ignoreNullFields": "false"},
    )
