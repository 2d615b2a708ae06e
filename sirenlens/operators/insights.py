"""What a team's week says: noisiest applications, largest problem, concentration, pace.

Everything is computed for all published weeks at once, keyed by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.scalars import ratio
from sirenlens.functions.text import id_list, is_blank, rule_number, sort_rules
from sirenlens.operators.ordered import with_running
from sirenlens.operators.published import all_rule_ids, rule_key

c = F.col
SCOPE = ["run_id", "alert_schema"]


def with_id_arrays(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("core", id_list(c("core_rule_ids"))).withColumn(
        "gaps", id_list(c("readiness_rule_ids"))
    )


def by_application(alerts: DataFrame) -> DataFrame:
    """Per application and schema: alerts, flagged alerts and events, and the rules seen."""
    rule, llm = c("quality_state") == "rule_flagged", c("quality_state") == "llm_flagged"
    rows = c("row_count")
    grouped = alerts.groupBy(*SCOPE, "application").agg(
        F.count("*").alias("alerts"),
        F.count_if(rule).alias("rule_flagged_alerts"),
        F.count_if(llm).alias("llm_flagged_alerts"),
        F.sum(rows).alias("events"),
        F.sum(F.when(rule, rows).otherwise(0)).alias("rule_flagged_events"),
        F.sum(F.when(llm, rows).otherwise(0)).alias("llm_flagged_events"),
        *[
            F.max(F.array_contains(id_list(c("core_rule_ids")), r)).alias(f"has_{r}")
            for r in K.CORE_RULES
        ],
    )
    rules = F.array_compact(F.array(*[F.when(c(f"has_{r}"), F.lit(r)) for r in K.CORE_RULES]))
    flagged = c("rule_flagged_events") + c("llm_flagged_events")
    return (
        grouped.withColumn("rules", F.array_join(rules, ","))
        .drop(*[f"has_{r}" for r in K.CORE_RULES])
        .orderBy("run_id", flagged.desc(), c("events").desc(), "application", "alert_schema")
    )


def fire_rows(alerts: DataFrame) -> DataFrame:
    """Span, open hours and daily rate of every alert."""
    span = F.unix_micros("last_seen") - F.unix_micros("first_seen")
    hours = F.lit(float(K.HOUR_US))
    open_us = F.unix_micros("last_seen") - F.unix_micros("open_since")
    rate = c("row_count") * (F.lit(float(K.DAY_US)) / span)
    return alerts.select(
        *SCOPE,
        "application",
        "key_field",
        "row_count",
        (span / hours).alias("span_hours"),
        "max_episode_firing_rows",
        (open_us / hours).alias("open_hours"),
        F.when(span >= K.SPAM_MIN_SPAN_US, rate).alias("events_per_24h"),
        c("fire_pattern").alias("pattern"),
    )


def loudest(alerts: DataFrame, n: int) -> DataFrame:
    """Top ``n`` alerts by events per run and schema. The rank limit runs inside each map task
    before the shuffle."""
    order = Window.partitionBy(*SCOPE).orderBy(
        c("row_count").desc(), "application", "key_field"
    )
    return alerts.withColumn("position", F.row_number().over(order)).where(c("position") <= n)


def biggest(alerts: DataFrame) -> DataFrame:
    """The single alert with the most events per run, by a total order, as one aggregate."""
    key = F.struct((-c("row_count")).alias("n"), "alert_schema", "key_field", "application")
    best = alerts.groupBy("run_id").agg(F.min(key).alias("k"))
    return best.select(
        "run_id",
        c("k.alert_schema").alias("alert_schema"),
        c("k.application").alias("application"),
        c("k.key_field").alias("key_field"),
        (-c("k.n")).alias("row_count"),
    )


def primary_rules(alerts: DataFrame) -> DataFrame:
    """Rule-flagged alerts partitioned by their first core rule; counts sum to the flagged."""
    flagged = with_id_arrays(alerts.where(c("quality_state") == "rule_flagged"))
    first = F.try_element_at(sort_rules(c("core")), F.lit(1))
    return (
        flagged.withColumn("rule_id", first)
        .where(c("rule_id").isNotNull())
        .groupBy(*SCOPE, "rule_id")
        .agg(F.count("*").alias("alerts"))
    )


def largest_problem(totals: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per run: the core rule with the most events over both schemas, described where it is
    biggest, and the one other rule all its carriers share, if there is exactly one."""
    core = totals.where(c("rule_id").isin(*K.CORE_RULES))
    per_rule = core.groupBy("run_id", "rule_id").agg(F.sum("events").alias("n")).where(c("n") > 0)
    top = per_rule.groupBy("run_id").agg(
        F.min(F.struct((-c("n")).alias("n"), "rule_id")).alias("k")
    ).select("run_id", c("k.rule_id").alias("rule_id"))
    where = (
        core.join(top, ["run_id", "rule_id"])
        .groupBy("run_id", "rule_id")
        .agg(F.min(F.struct((-c("events")).alias("e"), "alert_schema", "alerts")).alias("k"))
        .select(
            "run_id",
            "rule_id",
            c("k.alert_schema").alias("alert_schema"),
            (-c("k.e")).alias("events"),
            c("k.alerts").alias("alerts"),
        )
    )
    carriers = (
        with_id_arrays(alerts)
        .join(where.select(*SCOPE, "rule_id"), SCOPE)
        .where(F.array_contains(c("core"), c("rule_id")))
        .withColumn("others", F.array_join(F.array_except("core", F.array("rule_id")), ","))
        .groupBy("run_id")
        .agg(F.min("others").alias("low"), F.max("others").alias("high"))
    )
    same = (c("low") == c("high")) & c("low").rlike(r"\AR\d+\z")
    return where.join(carriers, "run_id", "left").select(
        "run_id", "rule_id", "alert_schema", "events", "alerts",
        F.when(same, c("low")).alias("also"),
    )


def concentration(alerts: DataFrame) -> DataFrame:
    """Per run, for the schema with the most events: the smallest number of alerts that make at
    least 80 % of them. NULL ``k`` means nothing to say."""
    per_schema = alerts.groupBy(*SCOPE).agg(F.sum("row_count").alias("e"))
    chosen = per_schema.groupBy("run_id").agg(
        F.min(F.struct((-c("e")).alias("e"), "alert_schema")).alias("k")
    ).select("run_id", c("k.alert_schema").alias("alert_schema"))
    order = [-c("row_count"), c("application"), c("key_field")]
    mine = alerts.select(*SCOPE, "application", "key_field", "row_count").join(chosen, SCOPE)
    running = with_running(mine, SCOPE, order, {"covered": "row_count"})
    reached = 5 * c("covered") >= 4 * c("covered_total")
    first = running.groupBy(*SCOPE).agg(
        F.max("group_size").alias("n"),
        F.max("covered_total").alias("total"),
        F.min(F.when(reached, c("rank"))).alias("k"),
        F.min(F.when(reached, c("covered"))).alias("covered"),
    )
    tells = (c("n") > 2) & (c("total") > 0) & (c("k") < c("n"))
    pct = F.floor(100 * c("covered") / c("total") + 0.5).cast("long")
    return first.where(tells).select(*SCOPE, "k", "n", pct.alias("pct"), "covered", "total")


def visibility_findings(totals: DataFrame) -> DataFrame:
    """Hidden, unseen and unassessed counts per schema, one row per non-empty one."""
    kinds = F.array(
        F.struct(F.lit("unassessed").alias("kind"), c("unassessed").alias("n"),
                 F.lit(None).cast("long").alias("events")),
        F.struct(F.lit("hidden").alias("kind"), c("suppressed").alias("n"),
                 c("suppressed").alias("events")),
        F.struct(F.lit("unseen").alias("kind"), F.coalesce("unseen_alerts", F.lit(0)).alias("n"),
                 c("unseen").alias("events")),
    )
    flat = totals.select(*SCOPE, F.inline(kinds))
    shown = F.when(c("kind") == "unseen", F.coalesce(c("events") > 0, F.lit(False))).otherwise(c("n") > 0)
    return flat.where(shown)


def is_ready() -> Column:
    gaps = id_list(c("readiness_rule_ids"))
    critical = F.lower(F.coalesce("severity", F.lit(""))) == "critical"
    blocking = critical & F.array_contains(gaps, "R9")
    return ~F.array_contains(gaps, "R8") & ~F.array_contains(gaps, "R10") & ~blocking


def critical_without_runbook() -> Column:
    critical = F.lower(F.coalesce("severity", F.lit(""))) == "critical"
    return critical & F.array_contains(id_list(c("readiness_rule_ids")), "R9")


def readiness(alerts: DataFrame) -> DataFrame:
    v2 = alerts.where(c("alert_schema") == "v2")
    return v2.groupBy("run_id").agg(
        F.count("*").alias("v2_alerts"),
        F.count_if(is_ready()).alias("ready"),
        F.count_if(critical_without_runbook()).alias("critical_without_runbook"),
    )


def key_findings(
    largest: DataFrame, visible: DataFrame, concentrated: DataFrame, ready: DataFrame
) -> DataFrame:
    """At most five findings per run, in fixed priority order."""
    ranks = {"largest": 1, "unassessed": 2, "concentration": 3, "hidden": 4, "unseen": 5,
             "readiness": 6}

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select("run_id", F.lit(name).alias("kind"), F.lit(ranks[name]).alias("priority"))

    parts = [
        kind(largest, "largest"),
        kind(concentrated, "concentration"),
        kind(ready, "readiness"),
        *[
            kind(visible.where(c("kind") == k).select("run_id").distinct(), k)
            for k in ("unassessed", "hidden", "unseen")
        ],
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    order = Window.partitionBy("run_id").orderBy("priority")
    return union.withColumn("position", F.row_number().over(order)).where(c("position") <= 5)


def rules_left(alerts: DataFrame) -> DataFrame:
    """Per run: v1 alerts, applications and rules still to move."""
    v1 = alerts.where(c("alert_schema") == "v1")
    return v1.groupBy("run_id").agg(
        F.count("*").alias("v1_alerts"),
        F.count_distinct("application").alias("v1_applications"),
        F.count_distinct(rule_key()).alias("rules_left"),
    )


def effort(weeks: DataFrame, left: DataFrame) -> DataFrame:
    """Configured effort to rebuild what is left."""
    per_rule = F.coalesce(
        c("v1_rule_effort_days").cast("double"), F.lit(K.EFFORT_DAYS_PER_RULE)
    )
    rules = F.coalesce("rules_left", F.lit(0))
    return weeks.join(left, "run_id", "left").select(
        "run_id",
        "team_id",
        "window_end",
        rules.alias("rules_left"),
        per_rule.alias("effort_days_per_rule"),
        c("v1_rule_effort_days").isNotNull().alias("effort_is_override"),
        (rules * per_rule).alias("effort_days"),
        (rules * per_rule / F.lit(float(K.WORKING_DAYS))).alias("effort_weeks"),
    )


def lookback(history: DataFrame) -> DataFrame:
    """Of each week's history, the unbroken earlier weeks: the lookback stops at a basis change
    or at a week that was not published."""
    order = Window.partitionBy("run_id").orderBy("age")
    newer_end = F.lag("past_end").over(order)
    newer_changed = F.lag("past_basis_changed").over(order)
    stop = (
        F.when(c("age") == 0, F.lit(None))
        .when(newer_changed, "basis")
        .when(newer_end != c("past_end") + F.expr("INTERVAL 7 DAYS"), "gap")
    )
    stopped = history.withColumn("stop", stop)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return stopped.withColumn("broken", F.count("stop").over(running) > 0).withColumn(
        "used", (c("age") > 0) & ~c("broken")
    )


def pace(history: DataFrame, week_rules: DataFrame, efforts: DataFrame) -> DataFrame:
    """The measured pace of retiring v1 rules and the week it projects, or why there is none.

    Retired rules are found by joins on the rule key, so no week's rule set is ever collected.
    """
    walked = lookback(history)
    found = walked.groupBy("team_id", "run_id", "window_end").agg(
        F.count_if(c("used")).alias("lookback_weeks"),
        F.min_by("stop", F.when(c("stop").isNotNull(), c("age"))).alias("stop"),
    )
    keys = week_rules.select(c("run_id").alias("past_run_id"), "rule_key")
    seen = walked.where(c("used")).select("run_id", "past_run_id").join(keys, "past_run_id")
    now = week_rules.select("run_id", "rule_key")
    retired = (
        seen.select("run_id", "rule_key")
        .distinct()
        .join(now, ["run_id", "rule_key"], "left_anti")
        .groupBy("run_id")
        .agg(F.count("*").alias("retired"))
    )
    joined = (
        found.join(retired, "run_id", "left")
        .fillna(0, subset=["retired"])
        .join(efforts.select("run_id", "rules_left"), "run_id")
    )
    enough, moving = c("lookback_weeks") >= 2, c("retired") >= 2
    per_week = ratio(c("retired"), c("lookback_weeks"))
    ahead = F.ceil(c("rules_left") / c("pace_per_week")).cast("int")
    reason = (
        F.when(~enough & (c("stop") == "basis"), "measured differently")
        .when(~enough & (c("stop") == "gap"), "a week before was not published")
        .when(~enough, "too few weeks published")
        .when(~moving, "too few rules stopped firing")
    )
    projected = F.when(
        enough & moving,
        F.date_add(F.to_date("window_end"), F.when(c("rules_left") == 0, 0).otherwise(7 * ahead)),
    )
    return (
        joined.withColumn("pace_per_week", F.when(enough & moving, per_week))
        .withColumn("projected_week_end", projected)
        .withColumn("no_estimate_reason", reason)
        .withColumn("retired", F.when(enough, c("retired")))
    )


def top_applications(alerts: DataFrame, n: int = 3) -> DataFrame:
    """Per schema and rule: the applications with the most events of alerts carrying it."""
    carried = alerts.select(
        *SCOPE, "application", "row_count", F.explode(F.array_distinct(all_rule_ids())).alias("rule_id")
    )
    events = carried.groupBy(*SCOPE, "rule_id", "application").agg(
        F.sum("row_count").alias("events")
    )
    order = Window.partitionBy(*SCOPE, "rule_id").orderBy(c("events").desc(), "application")
    top = events.withColumn("position", F.row_number().over(order)).where(c("position") <= n)
    named = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "application"))), lambda a: a["application"]
    )
    return top.groupBy(*SCOPE, "rule_id").agg(F.array_join(named, ", ").alias("applications"))


def changes(totals: DataFrame) -> DataFrame:
    """Per run and core rule, both schemas side by side, biggest first."""
    wide = (
        totals.where(c("rule_id").isin(*K.CORE_RULES))
        .groupBy("run_id", "rule_id")
        .pivot("alert_schema", list(K.SCHEMAS))
        .agg(F.sum("events").alias("events"), F.sum("alerts").alias("alerts"))
    )
    peak = F.greatest(F.coalesce("v1_events", F.lit(0)), F.coalesce("v2_events", F.lit(0)))
    return wide.withColumn("max_events", peak).orderBy(
        "run_id", c("max_events").desc(), rule_number(c("rule_id"))
    )


def model_findings(alerts: DataFrame) -> DataFrame:
    flagged = alerts.where((c("quality_state") == "llm_flagged") & c("llm_principle_id").isNotNull())
    return flagged.groupBy(*SCOPE, c("llm_principle_id").alias("principle_id")).agg(
        F.count("*").alias("alerts"), F.sum("row_count").alias("events")
    )


def listed(alerts: DataFrame, n: int = 8) -> DataFrame:
    """Top alerts hidden by every panel (``hidden``) and on no panel (``unseen``) per run, with
    the full list's size per schema."""
    lists = F.array_compact(
        F.array(
            F.when(F.array_contains(id_list(c("core_rule_ids")), "R5"), F.lit("hidden")),
            F.when(c("unseen"), F.lit("unseen")),
        )
    )
    picked = alerts.select(*SCOPE, "application", "key_field", "row_count", F.explode(lists).alias("list"))
    sizes = picked.groupBy("run_id", "list", "alert_schema").agg(F.count("*").alias("schema_total"))
    order = Window.partitionBy("run_id", "list").orderBy(
        c("row_count").desc(), "alert_schema", "application", "key_field"
    )
    top = picked.withColumn("position", F.row_number().over(order)).where(c("position") <= n)
    return top.join(sizes, ["run_id", "list", "alert_schema"])


def gap_counts(alerts: DataFrame) -> DataFrame:
    v2 = alerts.where(c("alert_schema") == "v2")
    gaps = id_list(c("readiness_rule_ids"))
    return v2.groupBy("run_id").agg(
        *[F.count_if(F.array_contains(gaps, r)).alias(r.lower()) for r in K.READINESS_RULES]
    )


def blocking_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where((c("alert_schema") == "v2") & critical_without_runbook()).orderBy(
        "run_id", c("row_count").desc(), "application", "key_field"
    )


def pattern_counts(alerts: DataFrame) -> DataFrame:
    return (
        alerts.where(c("fire_pattern").isNotNull())
        .groupBy(*SCOPE, "fire_pattern")
        .agg(F.count("*").alias("alerts"), F.sum("row_count").alias("events"))
    )


def dominant_pattern(counts: DataFrame) -> DataFrame:
    """Per run: the pattern with most alerts, then events, then priority."""
    rank = F.array_position(F.array(*[F.lit(p) for p in K.FIRE_PATTERNS]), c("fire_pattern"))
    summed = counts.groupBy("run_id", "fire_pattern").agg(
        F.sum("alerts").alias("alerts"), F.sum("events").alias("events")
    )
    key = F.struct(
        (-c("alerts")).alias("a"), (-c("events")).alias("e"), rank.alias("r"), "fire_pattern"
    )
    best = summed.groupBy("run_id").agg(F.min(key).alias("k"))
    return best.select("run_id", c("k.fire_pattern").alias("fire_pattern"))


# ------------------------------------------------------------------ sizing and dashboards


#: Registers of a sketch, as a power of two, and what of its estimates lies within how much: 99 % within
#: 2.6 standard errors of 1.04 / sqrt(2**12).
SKETCH_BITS, SKETCH_ERROR = 12, 2.6 * 1.04 / 64


def _probed() -> dict[str, Column]:
    """What is counted distinctly, each as one value; NULL where it does not count."""
    component = F.coalesce("component", F.lit(""))
    named = ~is_blank(c("node_name"))
    return {
        "applications": F.xxhash64("application"),
        "alerts": F.xxhash64("application", "key_field"),
        "scopes": F.xxhash64("application", component),
        "nodes": F.when(named, F.xxhash64("application", component, "node_name")),
        "node_scopes": F.when(named, F.xxhash64("application", component)),
    }


def probe_sketches(scoped: DataFrame) -> DataFrame:
    """``alert_schema, snapshot_date, rows`` and a mergeable sketch of each distinct figure: a few kilobytes
    for each schema and day, from which any span of days is answered without its rows."""
    sketches = [F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias(name) for name, value in _probed().items()]
    return scoped.groupBy("alert_schema", "snapshot_date").agg(F.count("*").alias("rows"), *sketches)


def scale_probe(sketches: DataFrame) -> DataFrame:
    """Sizing figures per schema over the days of ``sketches``. Distincts here are approximate and named so."""
    names = list(_probed())
    merged = sketches.groupBy("alert_schema").agg(
        F.sum("rows").alias("rows"),
        *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(f"approx_{name}") for name in names],
        F.sum(F.hll_sketch_estimate("alerts")).alias("approx_sum_daily_distinct"),
    )
    return merged.select(
        "*",
        ratio(c("approx_nodes"), c("approx_node_scopes")).alias("approx_node_ratio"),
        ratio(c("approx_alerts"), c("approx_scopes")).alias("approx_key_ratio"),
        ratio(c("approx_sum_daily_distinct"), c("approx_alerts")).alias("approx_key_reuse"),
    )


def probe_against_exact(probe: DataFrame, scoped: DataFrame, error: float = SKETCH_ERROR) -> DataFrame:
    """The exact figures beside ``probe``, and whether each approximate one is within ``error`` of its own;
    a ratio of two within twice that. Exact distincts count groups, one figure at a time."""
    out = probe
    for name, value in _probed().items():
        grain = scoped.select("alert_schema", value.alias("v")).where(c("v").isNotNull()).distinct()
        out = out.join(grain.groupBy("alert_schema").agg(F.count("*").alias(name)), "alert_schema", "left")
    daily = scoped.select("alert_schema", "snapshot_date", _probed()["alerts"].alias("v")).distinct()
    out = out.join(daily.groupBy("alert_schema").agg(F.count("*").alias("sum_daily_distinct")), "alert_schema", "left")
    names = [*_probed(), "sum_daily_distinct"]
    out = out.fillna(0, subset=names)
    near = [(F.abs(c(f"approx_{n}") - c(n)) <= F.lit(error) * c(n)).alias(f"{n}_within") for n in names]
    exact = {
        "node_ratio": ratio(c("nodes"), c("node_scopes")),
        "key_ratio": ratio(c("alerts"), c("scopes")),
        "key_reuse": ratio(c("sum_daily_distinct"), c("alerts")),
    }
    close = [
        (F.abs(c(f"approx_{n}") - value) <= F.lit(2.1 * error) * value).alias(f"{n}_within") for n, value in exact.items()
    ]
    return out.select("alert_schema", "rows", *names, *near, *close)


def distinct_and_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact distinct alerts and rows per ``keys``, via the identity grain."""
    grain = rows.groupBy(*keys, "application", "key_field").agg(F.count("*").alias("n"))
    return grain.groupBy(*keys).agg(
        F.count("*").alias("distinct_alerts"), F.sum("n").alias("rows")
    )


def distinct_per_day(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Exact distinct alerts per schema and day, days without rows included."""
    counted = distinct_and_rows(rows, ["alert_schema", "snapshot_date"])
    return calendar.join(counted, ["alert_schema", "snapshot_date"], "left").fillna(
        0, subset=["distinct_alerts", "rows"]
    )


def calendar_of(rows: DataFrame) -> DataFrame:
    """Every date from a schema's first to its last row."""
    span = rows.groupBy("alert_schema").agg(
        F.min("snapshot_date").alias("lo"), F.max("snapshot_date").alias("hi")
    )
    return span.select(
        "alert_schema", F.explode(F.sequence("lo", "hi")).alias("snapshot_date")
    )


def top_operators(rows: DataFrame, n: int = 50) -> DataFrame:
    counted = distinct_and_rows(rows, ["alert_schema", "operator"])
    order = Window.partitionBy("alert_schema").orderBy(c("distinct_alerts").desc(), "operator")
    return counted.withColumn("position", F.row_number().over(order)).where(c("position") <= n)
