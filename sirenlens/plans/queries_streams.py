"""Registered queries: the streaming path, drained over the ``events`` table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.operators import suppression as V
from sirenlens.operators.identity import ID
from sirenlens.operators.window import scope_alerts, span_of
from sirenlens.plans import sample
from sirenlens.plans.base import day, n, query, us
from sirenlens.plans.oracle import ID as ID_SQL
from sirenlens.plans.oracle import sql
from sirenlens.plans.store import _key, window_analysis
from sirenlens.session import materialize, shared_dir, ship_package
from sirenlens.sources.events import alerts_from_table
from sirenlens.streaming import incremental as S

c = F.col
LATE = "event_id % 100 = 7 AND ts < TIMESTAMP '2024-01-10'"
#: Where the arriving steps end.
STEPS = ("2024-01-06", "2024-01-11", "2024-01-16", "2024-01-20", "2024-01-25")
_folders: dict[tuple[str, ...], str] = {}


def _arrivals(spark: SparkSession, sf: str, folder: str, late: bool = False, close: bool = False) -> Iterator[DataFrame]:
    """The events arriving in steps by time, as a stream after each of them; with ``late``, a few old rows
    arrive with the step after the one that they belong before. Whoever iterates drains the stream before the next step.

    ``close`` ends the input with a row that is nothing but an instant three days later: the
    watermark then passes every day of the events.
    """
    events = spark.read.parquet(f"{sf}/events.parquet")
    step = F.when(F.lit(late) & F.expr(LATE), STEPS.index("2024-01-16") + 1)
    for k, until in enumerate(STEPS):
        step = step.when(c("ts") < F.lit(until).cast("timestamp_ntz"), k)
    step = step.otherwise(len(STEPS))
    arrivals = [events.where(step == i) for i in range(len(STEPS) + 1)]
    if close:
        end = events.agg((F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
        arrivals.append(end.select("ts", *blank).select(events.columns))
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        yield S.read_stream(spark, folder, events.schema)


def _scope(spark: SparkSession):
    reg = sample.registry(spark)
    specs = sample.window_specs()
    runs = sample.runs(spark, specs)
    return lambda rows: scope_alerts(rows, reg.team_operators, runs, span_of(specs))


def _ingested(spark: SparkSession, sf: str) -> str:
    """The partial facts of the stream, drained once per session and folder."""
    key = _key(spark, sf)
    if key not in _folders:
        folder = f"{shared_dir(spark)}/sirenlens/stream-{uuid.uuid4().hex}"
        reg = sample.registry(spark)
        plans = materialize(V.panel_plans(reg, V.number_leaves(V.interpret_leaves(reg))), "panel-plans")
        owned = _scope(spark)
        for stream in _arrivals(spark, sf, f"{folder}/in", late=True):
            rows = stream.withColumn("ts", c("ts").cast("timestamp"))
            S.ingest(rows, lambda batch: owned(alerts_from_table(batch)), plans, f"{folder}/facts", K.DAY_US)
        _folders[key] = f"{folder}/facts"
    return _folders[key]



def _kept_sql(final: str) -> str:
    """The batch SQL over the rows that were not late."""
    return sql(final).replace("FROM events) e", f"FROM events WHERE NOT ({LATE})) e")


@query("t01_incremental_facts", _kept_sql(f"SELECT {ID_SQL}, CAST(snapshot_date AS VARCHAR) AS snapshot_date, CAST(r1 + 2 * r2 + 4 * r3 + 8 * r4 + 16 * r7 + 32 * r8 + 64 * r9 + 128 * r10 AS INT) AS rule_mask, hides_b1 AS hidden, count(*) AS n FROM judged GROUP BY ALL"))
def t01(spark: SparkSession, sf: str) -> DataFrame:
    merged = S.merged_signatures(spark, _ingested(spark, sf))
    return merged.groupBy(*ID, "snapshot_date", "rule_mask", "hidden").agg(F.sum("n").alias("n")).select(
        *ID, day(), "rule_mask", "hidden", "n"
    )


def _streamed(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table of the facts that the finalizer wrote when the stream had passed the window."""
    folder = _ingested(spark, sf)
    S.finalize_due(spark, folder, sample.registry(spark), sample.runs(spark, sample.window_specs()), K.DAY_US)
    return S.stored_facts(spark, folder, table)


@query("t01_stream_days", _kept_sql("""SELECT v.run_id, v.alert_schema, CAST(v.snapshot_date AS VARCHAR) AS snapshot_date, alerts, distinct_alerts, key_inflation_denominator, node_name_numerator, node_name_denominator,
CAST(coalesce(f, 0) AS BIGINT) AS flagged_by_rule, coalesce(fd, 0) AS flagged_by_rule_distinct, CAST(coalesce(s, 0) AS BIGINT) AS suppressed, CASE WHEN u IS NOT NULL THEN CAST(coalesce(x.unseen, 0) AS BIGINT) END AS unseen, coalesce(un, 0) AS unassessed
FROM volume v LEFT JOIN unmeasured m ON m.run_id = v.run_id AND m.alert_schema = v.alert_schema LEFT JOIN (
SELECT d.run_id, d.alert_schema, d.snapshot_date, sum(d.flagged) AS f, count(*) FILTER (d.flagged > 0) AS fd, sum(d.suppressed) AS s, sum(d.unseen) AS unseen, count(*) FILTER (core_rule_ids = '') AS un
FROM days d JOIN ids i ON i.run_id = d.run_id AND i.alert_schema = d.alert_schema AND i.application = d.application AND i.key_field = d.key_field GROUP BY ALL) x
ON x.run_id = v.run_id AND x.alert_schema = v.alert_schema AND x.snapshot_date = v.snapshot_date"""))
def t01b(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "daily_metrics").select(
        "run_id", "alert_schema", day(),
        *n("alerts", "distinct_alerts", "key_inflation_denominator", "node_name_numerator", "node_name_denominator",
           "flagged_by_rule", "flagged_by_rule_distinct", "suppressed", "unseen", "unassessed"),
    )


@query("t01_stream_rules", _kept_sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, rule_id, CAST(match_count AS BIGINT) AS match_count, distinct_count FROM rule_days"))
def t01c(spark: SparkSession, sf: str) -> DataFrame:
    counts = _streamed(spark, sf, "daily_rule_counts")
    return counts.select("run_id", "alert_schema", day(), "rule_id", *n("match_count", "distinct_count"))


@query("t01_stream_identities", _kept_sql(f"""SELECT {ID_SQL}, doc_hash AS representative_hash, CAST(row_count AS BIGINT) AS row_count, epoch_us(first_seen) AS first_seen_us, epoch_us(last_seen) AS last_seen_us, core_rule_ids, readiness_rule_ids, unseen, fire_pattern, open_us AS open_since_us,
CASE WHEN core_rule_ids = '' THEN 'unassessed' ELSE 'rule_flagged' END AS quality_state FROM ids"""))
def t01d(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, "alert_findings").select(
        *ID, "representative_hash", *n("row_count"), us("first_seen"), us("last_seen"), "core_rule_ids", "readiness_rule_ids",
        "unseen", "fire_pattern", us("open_since"), "quality_state",
    )


@query("t01_runs_of_the_log", "SELECT CAST(count(*) AS BIGINT) AS batches, true AS bounded FROM (VALUES (1), (2), (3), (4), (5), (6)) b(k)")
def t01e(spark: SparkSession, sf: str) -> DataFrame:
    """How many batches came in, and whether fewer than FAN runs of each level are left of them."""
    folder = _ingested(spark, sf)
    left = spark.createDataFrame(S.Log(spark, folder).manifest(), S.MANIFEST)
    most = left.groupBy("level").count().agg(F.max("count").alias("most"))
    batches = spark.read.parquet(f"{folder}/progress").agg(F.count_distinct("batch").alias("batches"))
    return batches.crossJoin(most).select("batches", (c("most") < S.FAN).alias("bounded"))


@query("t02_late_rows", f"SELECT CAST(count(*) FILTER ({LATE}) AS BIGINT) AS late, CAST(count(*) FILTER (NOT ({LATE})) AS BIGINT) AS kept FROM events")
def t02(spark: SparkSession, sf: str) -> DataFrame:
    return S.late_counts(spark, _ingested(spark, sf))


_FIRING = f"SELECT {ID_SQL}, CAST(row_count AS BIGINT) AS row_count, clear_count, max_clear_cycles_24h, max_episode_firing_rows, open_us, span_us FROM firing"
_FIRING_COLUMNS = ("row_count", "clear_count", "max_clear_cycles_24h", "max_episode_firing_rows", "open_us", "span_us")


@query("t03_keyed_episode_state", sql(_FIRING))
def t03(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    folder = f"{shared_dir(spark)}/sirenlens/state-{uuid.uuid4().hex}"
    for stream in _arrivals(spark, sf, f"{folder}/in"):
        rows = alerts_from_table(stream).withWatermark("ts", "1 day")
        instants = S.drain(S.instant_stream(rows), f"{folder}/instants")
    # the watermark sees every instant; the runs' windows apply after it
    again = S.read_stream(spark, f"{folder}/instants", instants.schema)
    owned = _scope(spark)(again.withWatermark("ts", "1 day"))
    slices = S.drain(S.slice_stream(owned), f"{folder}/slices")
    return S.firing_of_slices(slices).select(*ID, *n(*_FIRING_COLUMNS))


@query("t04_instants_across_batches", _kept_sql(f"SELECT {ID_SQL}, us, count(*) FILTER (NOT is_clear) AS fires, count(*) FILTER (is_clear) AS clears FROM ordered GROUP BY ALL"))
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return S.merged_instants(spark, _ingested(spark, sf)).select(*ID, "us", "fires", "clears")


@query("t04_episodes_from_partials", _kept_sql(_FIRING))
def t04b(spark: SparkSession, sf: str) -> DataFrame:
    return S.finalize_firing(spark, _ingested(spark, sf)).select(*ID, *n(*_FIRING_COLUMNS))


@query("t05_distinct_per_day", sql("SELECT CAST(snapshot_date AS VARCHAR) AS day, alert_schema, count(DISTINCT (application, key_field)) AS distinct_alerts FROM alerts GROUP BY ALL"))
def t05(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/sirenlens/days-{uuid.uuid4().hex}"
    for stream in _arrivals(spark, sf, f"{folder}/in", close=True):
        rows = alerts_from_table(stream).withWatermark("ts", "1 day")
        days = S.drain(S.distinct_per_day(rows), f"{folder}/out")
    return days.select(F.date_format("day_start", "yyyy-MM-dd").alias("day"), "alert_schema", "distinct_alerts")


@query("t06_deferred_guard", _kept_sql("SELECT r.run_id, 'A3' AS panel_id, CAST(app_n AS BIGINT) AS matched_rows, CAST(total AS BIGINT) AS total_rows, CASE WHEN 2 * app_n > total THEN 'unmeasured' ELSE 'suppression' END AS outcome FROM runs r JOIN guard g ON g.run_id = r.run_id AND g.alert_schema = 'v2' WHERE team_id = 'team-a'"))
def t06(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    guarded = V.guard_leaves(S.merged_signatures(spark, _ingested(spark, sf)), a.leaves, a.runs)
    return guarded.where(c("panel_id") == "A3").select("run_id", "panel_id", *n("matched_rows", "total_rows"), "outcome")
