"""Registered queries: scans and sinks, scalar functions, row rules."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenlens.functions import scalars as X
from sirenlens.functions import text as T
from sirenlens.functions.instants import iso_date, iso_instant, parse_instant
from sirenlens.functions.labels import RULE_LABELS, label_rows, rule_labels
from sirenlens.operators import completeness as Cp
from sirenlens.operators import facts as W
from sirenlens.operators import published as P
from sirenlens.operators import rules as R
from sirenlens.operators.identity import ID, run_readiness
from sirenlens.operators.window import reconcile_scan, scope_alerts, team_scan
from sirenlens.plans import sample
from sirenlens.plans.base import day, n, query, us
from sirenlens.plans.oracle import norm_field, norm_message, q, sql
from sirenlens.plans.store import stored, window_analysis
from sirenlens.plans.team_week import run_rows
from sirenlens.session import materialize, shared_dir
from sirenlens.sources.documents import normalize_documents
from sirenlens.sources.events import alerts_from_events
from sirenlens.sources.registry import registry_from_text

c = F.col
START = sample.RUN_AT - timedelta(hours=168)
WINDOW = "ts >= TIMESTAMP '2024-01-08 18:00:00' AND ts < TIMESTAMP '2024-01-15 18:00:00'"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


# ------------------------------------------------------------------ scans, sources, sinks


@query("s01_team_scan", sql(f"SELECT seq, alert_schema, operator, epoch_us(ts) AS ts_us FROM alerts WHERE alert_schema = 'v1' AND operator IN ('op-a', 'op-b') AND {WINDOW}"))
def s01(spark: SparkSession, sf: str) -> DataFrame:
    rows = team_scan(alerts_from_events(spark, sf), "v1", ["op-a", "op-b"], START, sample.RUN_AT)
    return rows.select("seq", "alert_schema", "operator", us("ts"))


@query("s02_schema_scan_with_skip", sql("SELECT r.team_id, s.alert_schema, count(x.seq) AS rows FROM runs r CROSS JOIN (VALUES ('v1'), ('v2')) s(alert_schema) LEFT JOIN scoped x ON x.run_id = r.run_id AND x.alert_schema = s.alert_schema GROUP BY ALL"))
def s02(spark: SparkSession, sf: str) -> DataFrame:
    a = window_analysis(spark, sf)
    grid = a.runs.select("run_id", "team_id", F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("alert_schema"))
    counted = a.scoped.groupBy("run_id", "alert_schema").agg(F.count("*").alias("rows"))
    return grid.join(counted, ["run_id", "alert_schema"], "left").select(
        "team_id", "alert_schema", F.coalesce("rows", F.lit(0)).cast("long").alias("rows")
    )


@query("s03_all_teams_scan", sql("SELECT run_id, team_id, alert_schema, seq, application, key_field FROM scoped"))
def s03(spark: SparkSession, sf: str) -> DataFrame:
    return window_analysis(spark, sf).scoped.select("run_id", "team_id", "alert_schema", "seq", "application", "key_field")


#: Rows that the scan of s04 does not see.
LOST_SQL = "alert_schema = 'v1' AND operator = 'op-c' AND seq % 40 = 7"


@query("s04_complete_scan", sql(f"SELECT run_id, alert_schema, count(*) AS reported_total, count(*) FILTER (NOT ({LOST_SQL})) AS scanned, count(*) FILTER ({LOST_SQL}) = 0 AS complete FROM scoped GROUP BY ALL"))
def s04(spark: SparkSession, sf: str) -> DataFrame:
    """The source's totals by hour, kept on arrival, against a scan that loses rows of one operator."""
    a = window_analysis(spark, sf)
    totals = materialize(Cp.source_totals(a.alerts), "source-totals")
    reported = Cp.reported_totals(totals, a.reg.team_operators, a.runs).where("reported_total > 0")
    seen = scope_alerts(a.alerts.where(~F.expr(LOST_SQL)), a.reg.team_operators, a.runs, a.span)
    return reconcile_scan(seen, reported)


@query("s04_source_files", """SELECT event_type, expected, found, CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN found < expected THEN 'short' WHEN found > expected THEN 'long' ELSE 'ok' END AS status
FROM (SELECT event_type, CASE WHEN event_type <> 'signup' THEN count(*) END AS expected,
CASE WHEN event_type = 'click' THEN count(*) FILTER (event_id % 10 <> 3) WHEN event_type = 'view' THEN 2 * count(*) WHEN event_type <> 'error' THEN count(*) END AS found FROM events GROUP BY event_type) x""")
def s04b(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the files that arrived against the footers of those that are there: one is gone, one
    is short, one was written twice, and one is not in the manifest."""
    e = events(spark, sf).select("event_id", "event_type")
    folder = f"{shared_dir(spark)}/source-{uuid.uuid4().hex}"
    kept = e.where((c("event_type") != "error") & ~((c("event_type") == "click") & (c("event_id") % 10 == 3)))
    kept.union(kept.where("event_type = 'view'")).write.partitionBy("event_type").parquet(folder)
    of_type = F.regexp_extract("file", "event_type=([^/]*)", 1).alias("event_type")
    found = Cp.footer_counts(spark, folder).groupBy(of_type).agg(F.sum("rows").alias("rows"))
    manifest = e.where("event_type <> 'signup'").groupBy("event_type").agg(F.count("*").alias("rows"))
    return Cp.file_problems(manifest, found, ["event_type"])


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    """Alert documents as JSON text, some of them broken, from the projected events."""
    a = alerts_from_events(spark, sf)
    code = F.when(c("severity").isin("error", "critical"), 5).when(c("severity").isin("major", "high"), 4).when(c("severity") == "warning", 3).otherwise(1)
    stamp = F.when(c("seq") % 89 == 0, "12:00").otherwise(iso_instant(c("ts"))).alias("@timestamp")
    shared = ["application", "key_field", "message", "operator", code.alias("severity"),
              (c("seq") % 7).alias("node_name"), "alert_rule_url", "provider", "time_created", stamp]
    v1 = F.to_json(F.struct(c("component").alias("object"), *shared))
    v2 = F.to_json(F.struct("component", "status", "impact", "runbook_url", *shared))
    text = F.when(c("seq") % 97 == 0, "{not json").when(c("alert_schema") == "v2", v2).otherwise(v1)
    return a.select("alert_schema", text.alias("raw"), "seq")


GOOD = "seq % 97 <> 0 AND seq % 89 <> 0"


@query("s05_json_documents", sql("SELECT seq, alert_schema, CASE WHEN seq % 97 = 0 THEN 'not a JSON document' WHEN seq % 89 = 0 THEN 'unusable @timestamp' ELSE 'alert' END AS outcome FROM alerts"))
def s05(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = normalize_documents(_documents(spark, sf))
    return good.select("seq", "alert_schema", F.lit("alert").alias("outcome")).union(
        bad.select("seq", "alert_schema", c("reason").alias("outcome"))
    )


DOC_SQL = "'{\"registry_version\":\"' || s_suppkey || '\",\"teams\":[{\"team_id\":\"team-' || s_nationkey || '\",\"display_name\":\"n\",\"v1_operators\":[\"op-' || (s_suppkey % 37) || '\"],\"v2_operator\":' || CASE WHEN s_suppkey % 3 = 0 THEN '\"OP-' || s_suppkey || '\"' ELSE 'null' END || '}]}'"


def _registry_docs(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda x: F.lit(x)
    key, nation = c("s_suppkey").cast("string"), c("s_nationkey").cast("string")
    v2 = F.when(c("s_suppkey") % 3 == 0, F.concat(t('"OP-'), key, t('"'))).otherwise("null")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.concat(
            t('{"registry_version":"'), key, t('","teams":[{"team_id":"team-'), nation,
            t('","display_name":"n","v1_operators":["op-'), (c("s_suppkey") % 37).cast("string"),
            t('"],"v2_operator":'), v2, t("}]}"),
        ).alias("text")
    )


@query("s06_registry_source", f"SELECT sha256({DOC_SQL}) AS registry_sha256, CAST(s_suppkey AS VARCHAR) AS registry_version, 'team-' || s_nationkey AS team_id, CASE WHEN s_suppkey % 3 = 0 THEN 'OP-' || s_suppkey END AS v2_operator FROM supplier")
def s06(spark: SparkSession, sf: str) -> DataFrame:
    reg = registry_from_text(_registry_docs(spark, sf))
    return reg.teams.select("registry_sha256", "registry_version", "team_id", "v2_operator")


@query("s07_replace_run_sink", sql("SELECT run_id, alert_schema, count(*) AS days, CAST(sum(alerts) AS BIGINT) AS alerts FROM volume GROUP BY ALL", "weekly"))
def s07(spark: SparkSession, sf: str) -> DataFrame:
    metrics = stored(spark, sf).store.daily_metrics
    path = f"{shared_dir(spark)}/sirenlens/sink-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    W.replace_runs(metrics, path)
    # writing two teams' weeks again replaces exactly those runs
    W.replace_runs(metrics.where(c("team_id") == "team-a"), path)
    back = spark.read.parquet(path)
    return back.groupBy("run_id", "alert_schema").agg(
        F.count("*").alias("days"), F.sum("alerts").cast("long").alias("alerts")
    )


@query("s08_published_runs_are_refused", sql("SELECT run_id FROM pubs WHERE withdrawn_at IS NULL", "weekly"))
def s08(spark: SparkSession, sf: str) -> DataFrame:
    s = stored(spark, sf).store
    return W.refuse_published(s.runs, s.publications).select("run_id")


@query("s09_insert_if_absent", sql("SELECT DISTINCT application, key_field FROM outcomes WHERE assessment IS NOT NULL AND (application, key_field) NOT IN (SELECT (application, key_field) FROM outcomes WHERE principle_id = 'NONE')", "weekly"))
def s09(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = stored(spark, sf).facts.new_verdicts
    existing = verdicts.where(c("principle_id") == "NONE")
    keys = ["application", "key_field", "prompt_version", "model_version"]
    return W.absent(verdicts, existing, keys).select("application", "key_field")


@query("s10_projection_defaults", sql("SELECT run_id, alert_schema, application, key_field, CAST(row_count AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS clear_count, CAST(NULL AS VARCHAR) AS environment FROM findings", "weekly"))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    partial = stored(spark, sf).store.alert_findings.drop("clear_count", "environment")
    text = dict.fromkeys(ID, "string")
    return W.project(partial, {**text, "row_count": "long", "clear_count": "long", "environment": "string"})


@query("s11_csv_rule_counts", sql("SELECT run_id, team_id, alert_schema AS schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, rule_id, ruleset_version, CAST(CAST(match_count AS BIGINT) AS VARCHAR) AS match_count, CAST(distinct_count AS VARCHAR) AS distinct_count FROM rule_days JOIN (SELECT run_id, ruleset_version FROM runs) r USING (run_id)", "weekly"))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return W.rule_counts_csv(stored(spark, sf).store.daily_rule_counts)


def _plain(e: str, kind: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace(CAST(CAST({e} AS {kind}) AS VARCHAR), '0+$', ''), '[.]$', ''), '')"


def _instant(e: str) -> str:
    return f"coalesce(strftime({e}, '%Y-%m-%dT%H:%M:%S.%gZ'), '')"


def _cell(e: str) -> str:
    text = f"CAST({e} AS VARCHAR)"
    return f"coalesce(CASE WHEN regexp_matches({text}, '^[-=+@]') THEN '''' || {text} ELSE {text} END, '')"


def _csv_twin(headers: tuple[tuple[str, str], ...], special: dict[str, str]) -> str:
    return ", ".join(f"{special.get(col) or _cell(col)} AS {header}" for header, col in headers)


_DAILY_CELLS = {name: _instant(name) for name in ("bucket_start", "bucket_end")}
_DAILY_CELLS |= {name: _plain(name, kind) for name, kind in W.RATE_TYPES.items()}


@query("s11_csv_daily_metrics", sql(f"SELECT {_csv_twin(W.DAILY_HEADERS, _DAILY_CELLS)} FROM metrics", "weekly"))
def s11b(spark: SparkSession, sf: str) -> DataFrame:
    return W.daily_metrics_csv(stored(spark, sf).store.daily_metrics)


_WORKLIST_CELLS = {name: _instant(name) for name in ("first_seen", "last_seen")}
_WORKLIST_CELLS["open_since"] = _instant("make_timestamp(open_us)")
#: The SQL twin has no text of the classifier and no environment.
_COMPARED = tuple(h for h in W.WORKLIST_HEADERS if h[0] not in ("llm_justification", "environment"))


@query("s11_csv_worklist", sql(f"SELECT {_csv_twin(_COMPARED, _WORKLIST_CELLS)} FROM findings", "weekly"))
def s11c(spark: SparkSession, sf: str) -> DataFrame:
    return W.worklist_csv(stored(spark, sf).store.alert_findings).select(*[header for header, _ in _COMPARED])


@query("s12_formula_cells", """SELECT k, coalesce(CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END, '') AS cell
FROM (SELECT 'b' || c_custkey AS k, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS v FROM customer UNION ALL
SELECT 'n' || c_custkey, CASE WHEN c_acctbal >= 5000 THEN '=' || c_name WHEN c_acctbal >= 0 THEN c_name END FROM customer UNION ALL
SELECT 'u' || page_id, substr(url, strpos(url, '/')) FROM pages UNION ALL SELECT 'p' || page_id, substr('@+=-a', CAST(1 + length(url) % 5 AS INT)) || url FROM pages) t""")
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """Balances of either sign, names, parts of addresses."""
    customer, pages = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    key = lambda tag, name: F.concat(F.lit(tag), c(name).cast("string")).alias("k")
    balance = c("c_acctbal")
    name = F.when(balance >= 5000, F.concat(F.lit("="), c("c_name"))).when(balance >= 0, c("c_name"))
    marked = F.concat(F.substring(F.lit("@+=-a"), 1 + F.length("url") % 5, F.lit(5)), c("url"))
    cells = (
        customer.select(key("b", "c_custkey"), balance.cast("decimal(18,2)").cast("string").alias("v"))
        .union(customer.select(key("n", "c_custkey"), name))
        .union(pages.select(key("u", "page_id"), F.substr("url", F.instr("url", "/"))))
        .union(pages.select(key("p", "page_id"), marked))
    )
    return cells.select("k", W.csv_text("v", "string").alias("cell"))


@query("s13_read_back_order", sql("SELECT run_id, alert_schema, CAST(snapshot_date AS VARCHAR) AS snapshot_date, rule_id, row_number() OVER (PARTITION BY run_id ORDER BY alert_schema, snapshot_date, CAST(substr(rule_id, 2) AS INT)) AS position FROM rule_days", "weekly"))
def s13(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    # a run has at most schemas x dates x rules rows here
    order = Window.partitionBy("run_id").orderBy("alert_schema", "snapshot_date", T.rule_number(c("rule_id")))
    rows = P.stored_rule_counts(stored(spark, sf).store.daily_rule_counts)
    return rows.withColumn("position", F.row_number().over(order)).select(
        "run_id", "alert_schema", day(), "rule_id", *n("position")
    )


@query("s14_latest_run", sql("SELECT team_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY run_at DESC, run_id DESC) AS r FROM runs) x WHERE r = 1 AND run_id IN (SELECT run_id FROM scoped)", "weekly"))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    return P.latest_runs(stored(spark, sf).store.runs).select("team_id", "run_id")


# ------------------------------------------------------------------ scalar functions


@query("p01_schema_adapter", sql(f"SELECT seq, alert_schema, component, status, impact, runbook_url, severity, CAST(seq % 7 AS VARCHAR) AS node_name FROM alerts WHERE {GOOD}"))
def p01(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = normalize_documents(_documents(spark, sf))
    return good.select("seq", "alert_schema", "component", "status", "impact", "runbook_url", "severity", "node_name")


@query("p02_string_coercion", "SELECT event_id, CAST(user_id AS VARCHAR) AS number_text, props AS object_text, event_type AS plain_text FROM (SELECT event_id, user_id, regexp_replace(props, ' ', '', 'g') AS props, event_type FROM events) t")
def p02(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.parse_json(F.concat(F.lit('{"n":'), c("user_id").cast("string"), F.lit(',"o":'), c("props"),
                                F.lit(',"t":"'), c("event_type"), F.lit('"}')))
    get = lambda path: F.try_variant_get(doc, path, "string")
    return events(spark, sf).select("event_id", get("$.n").alias("number_text"), get("$.o").alias("object_text"), get("$.t").alias("plain_text"))


#: How an instant is written, and what of it a reader gets back, in microseconds.
WRITTEN = (
    ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "us"), ("yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'", "us - us % 1000 - 7200000000"),
    ("yyyy-MM-dd HH:mm", "us - us % 60000000"), ("yyyy-MM-dd", "us - us % 86400000000"),
    ("yyyyMMdd'T'HHmmss", "us - us % 1000000"), ("yyyy-MM-dd'T'HH:mm:ss,SS'Z'", "us - us % 10000"),
    ("HH:mm", "NULL"), ("yyyy-M-d'T'", "NULL"), ("yyyy-'13'-dd", "NULL"),
)


@query("p03_parse_instant", "SELECT event_id, form, CAST(CASE form " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(WRITTEN))
       + f" END AS BIGINT) AS parsed_us FROM (SELECT event_id, epoch_us(ts) AS us, form FROM events, range({len(WRITTEN)}) r(form)) e "
       "UNION ALL SELECT event_id, 99, NULL FROM events")
def p03(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's instant in nine forms, and text that is none."""
    e = events(spark, sf).withColumn("ts", c("ts").cast("timestamp"))
    texts = [F.struct(F.lit(i).cast("long").alias("form"), F.date_format("ts", f).alias("t")) for i, (f, _) in enumerate(WRITTEN)]
    texts.append(F.struct(F.lit(99).cast("long").alias("form"), c("props").alias("t")))
    spread = e.select("event_id", F.inline(F.array(*texts)))
    return spread.select("event_id", "form", F.unix_micros(parse_instant(c("t"))).alias("parsed_us"))


@query("p04_utc_date", sql("SELECT seq, CAST(snapshot_date AS VARCHAR) AS snapshot_date FROM alerts"))
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return alerts_from_events(spark, sf).select("seq", day())


#: A severity as a document has it: padded digits, a name, or neither.
SEVERITY_SQL = (
    "CASE WHEN user_id % 3 = 0 THEN ' ' || upper(event_type) || ' ' WHEN user_id % 3 = 1 THEN '  ' "
    "WHEN event_id % 2 = 0 THEN ' ' || CAST(user_id % 7 AS VARCHAR) ELSE '00' || CAST(user_id % 7 AS VARCHAR) END"
)
SEVERITY = SEVERITY_SQL.replace("VARCHAR", "STRING")


@query("p05_severity_label", f"""SELECT event_id, s.schema, CASE WHEN t = '' THEN NULL WHEN n IS NULL THEN t ELSE coalesce(
CASE s.schema WHEN 'v1' THEN CASE n WHEN 5 THEN 'error' WHEN 4 THEN 'major' WHEN 3 THEN 'warning' WHEN 1 THEN 'clear' END
ELSE CASE n WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'warning' WHEN 1 THEN 'clear' END END, CAST(n AS VARCHAR)) END AS label
FROM (SELECT event_id, t, try_cast(t AS INT) AS n FROM (SELECT event_id, trim({SEVERITY_SQL}) AS t FROM events) x) e, (VALUES ('v1'), ('v2')) s(schema)""")
def p05(spark: SparkSession, sf: str) -> DataFrame:
    both = events(spark, sf).select("event_id", F.expr(SEVERITY).alias("v"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("schema"))
    return both.select("event_id", "schema", X.severity_label(c("schema"), c("v")).alias("label"))


@query("p06_severity_code", """SELECT 'e' || event_id AS k, CASE WHEN event_type = 'error' AND user_id % 3 < 2 THEN 5 END AS code FROM events UNION ALL
SELECT 'o' || o_orderkey, CASE lower(substr(o_orderpriority, 3)) WHEN 'high' THEN 4 END FROM orders""")
def p06(spark: SparkSession, sf: str) -> DataFrame:
    """Names of event types, some of them spoilt, and of order priorities, without their number."""
    e, o = events(spark, sf), spark.read.parquet(f"{sf}/orders.parquet")
    said = F.when(c("user_id") % 3 == 0, F.concat(F.lit("\t"), F.upper("event_type"), F.lit(" "))).when(
        c("user_id") % 3 == 1, c("event_type")
    ).otherwise(F.concat("event_type", F.lit("s")))
    names = e.select(F.concat(F.lit("e"), c("event_id").cast("string")).alias("k"), said.alias("v")).union(
        o.select(F.concat(F.lit("o"), c("o_orderkey").cast("string")), F.substr("o_orderpriority", F.lit(3)))
    )
    return names.select("k", X.severity_code(c("v")).alias("code"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


@query("p07_normalize_field", f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {norm_field('text')} AS t FROM documents) x")
def p07(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents."""
    t = documents(spark, sf).select("doc_id", T.normalize_field(c("text")).alias("t"))
    return t.select("doc_id", F.char_length("t").cast("long").alias("chars"), F.md5(F.encode("t", "utf-8")).alias("digest"))


@query("p08_normalize_message", f"SELECT conv_id, turn, {norm_message('text')} AS normalized FROM conversations")
def p08(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("conv_id", "turn", T.normalize_message(c("text")).alias("normalized"))


@query("p09_is_blank", r"SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_replace(line, '\s+', '', 'g') = '') AS blank FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) x GROUP BY 1")
def p09(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document."""
    spread = documents(spark, sf).select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    return spread.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_blank(c("line"))).alias("blank"))


#: What can be made of a page's address (other slashes, other schemes, no host), and whether it names
#: a host still where the page's own address does.
ADDRESSES = (
    ("url", True), ("upper(replace(url, '://', ':'))", True), ("replace(url, '://', ':////user:pw@')", True),
    ("replace(url, 'http', 'ftp')", False), ("substr(url, instr(url, '/'))", False), ("'https://?' || url", False),
    ("'http://user@:80/' || string(page_id)", False), ("'see ' || url", False),
)


@query("p10_http_url", "SELECT page_id, " + ", ".join(
    f"coalesce({str(same).lower()} AND regexp_matches(url, '^https?://[^/?#:@]'), false) AS a{i}" for i, (_, same) in enumerate(ADDRESSES)
) + " FROM pages")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", *[X.is_http_url(F.expr(e)).alias(f"a{i}") for i, (e, _) in enumerate(ADDRESSES)])


@query("p11_ratio", "SELECT event_id, CAST(user_id AS DOUBLE) / nullif(event_id % 5, 0) AS ratio FROM events")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", X.ratio(c("user_id"), c("event_id") % 5).alias("ratio"))


@query("p12_instant_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS instant, strftime(ts, '%Y-%m-%d') AS day FROM events")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    stamped = events(spark, sf).withColumn("ts", c("ts").cast("timestamp"))
    return stamped.select("event_id", iso_instant(c("ts")).alias("instant"), iso_date(c("ts")).alias("day"))


@query("p13_document_hash", sql("SELECT seq, doc_hash FROM alerts"))
def p13(spark: SparkSession, sf: str) -> DataFrame:
    return alerts_from_events(spark, sf).select("seq", "doc_hash")


@query("p14_text_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def p14(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("p15_compact_json", "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || ',\"event_id\":' || event_id || '}' AS text FROM events")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.to_json(F.struct("event_type", "user_id", "event_id")).alias("text"))


@query("p16_deterministic_ids", sql("SELECT run_id, alert_id, batch_id FROM answered", "weekly"))
def p16(spark: SparkSession, sf: str) -> DataFrame:
    t = stored(spark, sf).facts
    return t.batches.select("run_id", F.explode("alert_ids").alias("alert_id"), "batch_id")


@query("p17_rule_order", sql("SELECT run_id, alert_schema, application, key_field, string_agg(rule_id, ',' ORDER BY CAST(substr(rule_id, 2) AS INT)) AS rules FROM carried GROUP BY ALL", "weekly"))
def p17(spark: SparkSession, sf: str) -> DataFrame:
    f = stored(spark, sf).store.alert_findings.withColumn("ids", F.reverse(F.sort_array(P.all_rule_ids())))
    return f.where(F.size("ids") > 0).select(*ID, F.array_join(T.sort_rules(c("ids")), ",").alias("rules"))


@query("p18_half_up", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '—' ELSE CAST(round(CAST(event_id / 8.0 AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2))::VARCHAR END AS shown FROM events")
def p18(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(c("event_id") % 9 != 0, c("event_id") / F.lit(8.0))
    return events(spark, sf).select("event_id", X.half_up(value).alias("shown"))


@query("p19_percent", "SELECT event_id, CASE WHEN w <= 0 OR p <= 0 THEN '0%' WHEN p >= w THEN '100%' WHEN (200 * p + w) // (2 * w) < 1 THEN '<1%' ELSE least((200 * p + w) // (2 * w), 99) || '%' END AS share FROM (SELECT event_id, user_id AS p, event_id % 1000 AS w FROM events) t")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", X.percent(c("user_id"), c("event_id") % 1000).alias("share"))


@query("p20_clip", "SELECT event_id, CASE WHEN length(v) <= 9 THEN v ELSE rtrim(substr(v, 1, 8)) || '…' END AS clipped FROM (SELECT event_id, trim(regexp_replace('  ' || event_type || '   ' || event_id || '  x', '\\s+', ' ', 'g')) AS v FROM events) t")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    value = F.concat(F.lit("  "), c("event_type"), F.lit("   "), c("event_id").cast("string"), F.lit("  x"))
    return events(spark, sf).select("event_id", T.clip(value, 9).alias("clipped"))


@query("p21_json_field", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN props->>'$.k' END AS k FROM events")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.when(c("event_id") % 10 == 0, "{bad").otherwise(c("props"))
    return events(spark, sf).select("event_id", P.json_scalar(doc, "$.k").alias("k"))


@query("p22_json_fragment", "SELECT event_id, '[\"op-' || (user_id % 3) || '\"]' AS fragment, CASE WHEN user_id % 2 = 0 THEN 'x' END AS scalar, CAST(NULL AS VARCHAR) AS scalar_of_array FROM events")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.concat(F.lit('{"ops":["op-'), (c("user_id") % 3).cast("string"), F.lit('"],"v2":'),
                   F.when(c("user_id") % 2 == 0, '"x"').otherwise("null"), F.lit("}"))
    return events(spark, sf).select(
        "event_id", P.json_fragment(doc, "$.ops").alias("fragment"), P.json_scalar(doc, "$.v2").alias("scalar"),
        P.json_scalar(doc, "$.ops").alias("scalar_of_array"),
    )


@query("p23_attention_rank", sql("SELECT run_id, alert_schema, application, key_field, attention_rank FROM ranked", "weekly"))
def p23(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).store.alert_findings.select(*ID, P.attention_rank().alias("attention_rank"))


@query("p24_rule_membership", sql("SELECT run_id, alert_schema, application, key_field, list_contains(string_split(readiness_rule_ids, ','), 'R10') AS has_r10, list_contains(string_split(core_rule_ids, ','), 'R1') AS has_r1 FROM findings", "weekly"))
def p24(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf).store.alert_findings.select(
        *ID, T.ids_contain(c("readiness_rule_ids"), "R10").alias("has_r10"),
        T.ids_contain(c("core_rule_ids"), "R1").alias("has_r1"),
    )


@query("p25_worklist_filter", sql("SELECT run_id, alert_schema, application, key_field FROM ranked WHERE alert_schema = 'v1' AND quality_state = 'rule_flagged' AND list_contains(string_split(all_ids, ','), 'R7')", "weekly"))
def p25(spark: SparkSession, sf: str) -> DataFrame:
    alerts = stored(spark, sf).store.alert_findings
    return P.filter_worklist(alerts, "v1", "rule_flagged", "R7", attention_only=True).select(*ID)


@query("p26_id_list", r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS ids FROM conversations")
def p26(spark: SparkSession, sf: str) -> DataFrame:
    """The comma-joined parts of every turn."""
    return turns(spark, sf).select("conv_id", "turn", F.array_join(T.id_list(c("text")), "|").alias("ids"))


@query("p27_rule_key", sql("SELECT seq, CASE WHEN trim(coalesce(alert_rule_url, '')) <> '' THEN 'url:' || trim(alert_rule_url) ELSE 'app:' || application END AS rule_key FROM alerts"))
def p27(spark: SparkSession, sf: str) -> DataFrame:
    return alerts_from_events(spark, sf).select("seq", P.rule_key().alias("rule_key"))


LABEL_ROWS = ", ".join(
    f"({q(r)}, {q(p)}, {str(k).lower()}, {q(a)}, {q(b)}, {q(f)}, {q(w)})" for r, p, k, a, b, f, w in label_rows()
)


@query("p28_rule_labels", sql(f"SELECT run_id, alert_schema, application, key_field, x.rule_id, problem, action, fix, why FROM carried x JOIN (VALUES {LABEL_ROWS}) t(rule_id, pattern, critical, problem, action, fix, why) ON t.rule_id = x.rule_id AND t.pattern = CASE WHEN x.rule_id = 'R6' THEN coalesce(x.fire_pattern, '') ELSE '' END AND t.critical = (x.rule_id = 'R9' AND coalesce(x.severity, '') = 'critical')", "weekly"))
def p28(spark: SparkSession, sf: str) -> DataFrame:
    assert set(RULE_LABELS) == {f"R{i}" for i in range(1, 11)}
    found = stored(spark, sf).store.alert_findings.select(
        *ID, "fire_pattern", "severity", F.explode(P.all_rule_ids()).alias("rule_id")
    )
    keyed = found.select(
        *ID, "rule_id",
        F.when(c("rule_id") == "R6", F.coalesce("fire_pattern", F.lit(""))).otherwise("").alias("pattern"),
        ((c("rule_id") == "R9") & F.coalesce(c("severity") == "critical", F.lit(False))).alias("critical"),
    )
    return keyed.join(rule_labels(spark), ["rule_id", "pattern", "critical"]).select(
        *ID, "rule_id", "problem", "action", "fix", "why"
    )


# ------------------------------------------------------------------ row rules


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_rule_mask(window_analysis(spark, sf).scoped)


def _rule(name: str, rule: str, flag: str, extra: str = "") -> None:
    @query(name, sql(f"SELECT run_id, seq{extra} FROM judged WHERE {flag} > 0"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = _rows(spark, sf).where(R.has_rule(c("rule_mask"), rule))
        reason = {
            "R7": R.r7_reason(c("created_us")),
            "R8": R.r8_reason(),
            "R9": R.r9_reason(),
        }.get(rule)
        more = []
        if reason is not None:
            more = [reason.alias("reason")]
        elif rule in ("R1", "R2"):
            more = [T.normalize_message(c("message")).alias("normalized")]
        elif rule == "R10":
            more = [T.normalize_message(c("impact")).alias("normalized")]
        elif rule == "R3":
            named = F.transform(
                R.r3_violations(), lambda v: F.concat_ws(":", v["field"], v["reason"], v["normalized"])
            )
            more = [F.array_join(named, ";").alias("violations")]
        return rows.select("run_id", "seq", *more)


_rule("r01_generic_message", "R1", "r1", f", {norm_message('message')} AS normalized")
_rule("r02_heartbeat_message", "R2", "r2", f", {norm_message('message')} AS normalized")
_rule("r03_placeholder_metadata", "R3", "r3", ", CASE WHEN alert_schema = 'v1' THEN 'object' ELSE 'component' END || ':placeholder:unknown' AS violations")
_rule("r04_missing_rule_link", "R4", "r4")
_rule("r05_invalid_creation_time", "R7", "r7", ", r7_reason AS reason")
_rule("r06_missing_impact", "R8", "r8", ", r8_reason AS reason")
_rule("r07_missing_runbook", "R9", "r9", ", r9_reason AS reason")


@query("r08_technical_impact", sql(f"SELECT seq, {norm_message('impact')} AS normalized FROM alerts WHERE alert_schema = 'v2' AND {norm_message('impact')} IN ('high cpu', 'high cpu usage', 'cpu usage is high', 'cpu is high')"))
def r08(spark: SparkSession, sf: str) -> DataFrame:
    rows = alerts_from_events(spark, sf).where(R.r10())
    return rows.select("seq", T.normalize_message(c("impact")).alias("normalized"))


@query("r09_row_rule_dispatch", sql("SELECT run_id, seq, concat_ws(',', CASE WHEN r1 > 0 THEN 'R1' END, CASE WHEN r2 > 0 THEN 'R2' END, CASE WHEN r3 > 0 THEN 'R3' END, CASE WHEN r4 > 0 THEN 'R4' END, CASE WHEN r7 > 0 THEN 'R7' END) AS core, concat_ws(',', CASE WHEN r8 > 0 THEN 'R8' END, CASE WHEN r9 > 0 THEN 'R9' END, CASE WHEN r10 > 0 THEN 'R10' END) AS readiness FROM judged"))
def r09(spark: SparkSession, sf: str) -> DataFrame:
    mask = c("rule_mask")
    return _rows(spark, sf).select(
        "run_id", "seq", F.array_join(R.mask_ids(mask, ("R1", "R2", "R3", "R4", "R7")), ",").alias("core"),
        F.array_join(R.mask_ids(mask, ("R8", "R9", "R10")), ",").alias("readiness"),
    )


@query("r10_completion_ready", sql("SELECT run_id, alert_schema, application, key_field, ready FROM ids WHERE alert_schema = 'v2'", "wide"))
def r10(spark: SparkSession, sf: str) -> DataFrame:
    reps = window_analysis(spark, sf, sample.FAN).representatives.where(c("alert_schema") == "v2")
    return reps.select(*ID, R.completion_ready(c("rep_mask"), c("severity")).alias("ready"))


@query("r11_readiness_percent", sql("SELECT run_id, v2_identities, phase2_readiness_pct FROM run_facts WHERE v1_identities + v2_identities > 0", "wide"))
def r11(spark: SparkSession, sf: str) -> DataFrame:
    return run_readiness(window_analysis(spark, sf, sample.FAN).identities).select("run_id", "v2_identities", "phase2_readiness_pct")


@query("r12_phase", sql("SELECT run_id, team_id, v1_identities, v2_identities, phase_derived FROM run_facts", "wide"))
def r12(spark: SparkSession, sf: str) -> DataFrame:
    return run_rows(window_analysis(spark, sf, sample.FAN), False).select(
        "run_id", "team_id", *n("v1_identities", "v2_identities"), "phase_derived"
    )
