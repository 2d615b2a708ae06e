"""Reference SQL for the registered queries: one chain of named parts per configuration, from the
``events`` table to the facts, written independently of the DataFrame code.

``sql(final, kind)`` prefixes ``final`` with exactly the parts it reaches.
"""

from __future__ import annotations

import re

from sirenlens.functions import catalogs as K
from sirenlens.operators.window import RunSpec
from sirenlens.plans import sample
from sirenlens.plans.store import NOW
from sirenlens.sources.events import PROJECTION, key_expression


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def listing(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def enc(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN 'n' ELSE 's' || strlen({expr}) || ':' || {expr} END"


def enc_int(expr: str) -> str:
    return f"('d' || length(CAST({expr} AS VARCHAR)) || ':' || CAST({expr} AS VARCHAR))"


def stable_hash(fields: dict[str, str]) -> str:
    parts = [q(f"o{len(fields)}:")]
    for key in sorted(fields):
        parts += [q(f"s{len(key)}:{key}"), f"({fields[key]})"]
    return "sha256(" + " || ".join(parts) + ")"


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def norm_field(e: str) -> str:
    return f"regexp_replace(lower(regexp_replace({e}, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')"


def norm_message(e: str) -> str:
    return f"regexp_replace(regexp_replace({norm_field(e)}, '^[\\pP]+|[\\pP]+$', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def blank(e: str) -> str:
    return f"({e} IS NULL OR regexp_replace({e}, '\\s+', '', 'g') = '')"


def _document_hash() -> str:
    shared = {n: enc(n) for n in ("application", "message", "operator", "key_field", "time_created",
                                  "node_name", "alert_rule_url", "provider")}
    shared["severity"] = enc_int("severity_code")
    shared["@timestamp"] = enc(f"({iso('event_ts')})")
    v1 = stable_hash({**shared, "object": enc("component")})
    v2 = stable_hash({**shared, **{n: enc(n) for n in ("component", "status", "impact", "runbook_url")}})
    return f"CASE WHEN alert_schema = 'v2' THEN {v2} ELSE {v1} END"


def runs_sql(specs: list[RunSpec]) -> str:
    rows = ", ".join(
        f"({q(s.team_id)}, {q(s.display_name or s.team_id)}, TIMESTAMP '{s.run_at}', "
        f"{q(s.ruleset_version)}, {q(s.registry_version)}, {q(s.registry_sha256)}, "
        f"{q(s.registry_entry)}, CAST({q(s.model_version)} AS VARCHAR))"
        for s in specs
    )
    run_id = stable_hash(
        {
            "team_id": enc("team_id"),
            "run_at": enc(f"({iso('run_at')})"),
            "window_start": enc(f"({iso('window_start')})"),
            "registry_sha256": enc("registry_sha256"),
            "ruleset_version": enc("ruleset_version"),
            "prompt_version": enc(q(K.PROMPT_VERSION)),
            "model_version": enc("model_version"),
            "app_version": enc(q(K.APP_VERSION)),
        }
    )
    return f"""SELECT *, {run_id} AS run_id FROM (
  SELECT *, run_at - INTERVAL 168 HOUR AS window_start, run_at AS window_end FROM
  (VALUES {rows}) t(team_id, team_display_name, run_at, ruleset_version, registry_version,
   registry_sha256, registry_entry_snapshot, model_version)) r"""


def _severity() -> str:
    cases = " ".join(
        f"WHEN severity_code = {code} THEN CASE alert_schema WHEN 'v1' THEN '{a}' ELSE '{b}' END"
        for code, (a, b) in K.SEVERITY_NAMES.items()
    )
    return f"CASE {cases} ELSE CAST(severity_code AS VARCHAR) END"


BAD = listing(K.PLACEHOLDERS)
ID = "run_id, alert_schema, application, key_field"
HOST = ("regexp_replace(regexp_replace(regexp_extract(runbook_url, '(?is)^https?:/*([^/?#]*)', 1), "
        "'^.*@', ''), ':[^:]*$', '')")
IDS_CORE = ", ".join(f"CASE WHEN {r.lower()} > 0 THEN '{r}' END" for r in K.CORE_RULES)

ROUNDS = len(sample.WEEK_ENDS)
ANSWERED_KEYS = "(SELECT application, key_field, min(pick) AS pick FROM answered_{k} WHERE NOT lost GROUP BY ALL)"


def _round(k: int) -> dict[str, str]:
    """One round of classifier work: what is asked, its batches and answers, whom these serve later, and
    what is left for the next round."""
    of_key = "w.application = l.application AND w.key_field = l.key_field"
    not_asked = f"LEFT JOIN asked_{k} s ON s.run_id = l.run_id AND s.alert_id = l.alert_id"
    batch = {
        "run_id": enc("run_id"), "group_type": enc("group_type"), "group_value": enc("group_value"),
        "partition_index": enc_int("partition_index"), "alert_ids": "'a' || alert_count || ':' || encoded_ids",
        "prompt_version": enc(q(K.PROMPT_VERSION)), "model_version": enc(q(sample.MODEL)),
    }
    return {
        f"asked_{k}": f"SELECT * FROM left_{k} QUALIFY dense_rank() OVER (PARTITION BY application, key_field ORDER BY window_end, run_id) = 1",
        f"placed_{k}": f"""SELECT *, CASE WHEN rank0 < extra * (base + 1) THEN rank0 // (base + 1) ELSE extra + (rank0 - extra * (base + 1)) // base END AS partition_index
  FROM (SELECT *, n // parts AS base, n % parts AS extra FROM (
    SELECT *, (n + 199) // 200 AS parts FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, group_type, group_value ORDER BY key_field, application, alert_schema) - 1 AS rank0,
        count(*) OVER (PARTITION BY run_id, group_type, group_value) AS n FROM asked_{k}) a) b) c""",
        f"batches_{k}": f"""SELECT *, {stable_hash(batch)} AS batch_id
  FROM (SELECT run_id, group_type, group_value, partition_index, any_value(parts) AS partition_count, count(*) AS alert_count,
    string_agg('s64:' || alert_id, '' ORDER BY rank0) AS encoded_ids, string_agg(alert_id, ',' ORDER BY rank0) AS alert_ids,
    string_agg('s64:' || alert_id, '' ORDER BY rank0 DESC) AS reversed_ids
    FROM placed_{k} GROUP BY run_id, group_type, group_value, partition_index) b""",
        f"answered_{k}": f"""SELECT p.*, b.batch_id, substr(b.batch_id, 1, 1) IN ('0', '5', 'a') AS lost,
  (instr('0123456789abcdef', substr(alert_id, 1, 1)) - 1) % 5 AS pick
  FROM placed_{k} p JOIN batches_{k} b USING (run_id, group_type, group_value, partition_index)""",
        f"again_{k}": f"SELECT l.*, w.pick FROM left_{k} l JOIN {ANSWERED_KEYS.format(k=k)} w ON {of_key} {not_asked} WHERE s.alert_id IS NULL",
        f"left_{k + 1}": f"SELECT l.* FROM left_{k} l LEFT JOIN {ANSWERED_KEYS.format(k=k)} w ON {of_key} {not_asked} WHERE s.alert_id IS NULL AND w.application IS NULL",
    }


PARTS: dict[str, str] = {
    "owners": "SELECT * FROM (VALUES "
    + ", ".join(f"({q(a)}, {q(b)}, {q(o)})" for a, b, o in sample.TEAM_OPERATORS)
    + ") t(team_id, alert_schema, operator)",
    "alerts": f"""SELECT event_id AS seq, event_ts AS ts, CAST(event_ts AS DATE) AS snapshot_date,
  alert_schema, operator, application, key_field, component, node_name, message, provider, alert_rule_url,
  time_created, severity_code, {_severity()} AS severity,
  CASE WHEN alert_schema = 'v2' THEN status END AS status,
  CASE WHEN alert_schema = 'v2' THEN impact END AS impact,
  CASE WHEN alert_schema = 'v2' THEN runbook_url END AS runbook_url,
  {_document_hash()} AS doc_hash FROM proj""",
    "scoped": """SELECT a.*, r.run_id, r.team_id FROM alerts a
  JOIN owners o ON o.alert_schema = a.alert_schema AND o.operator = a.operator
  JOIN runs r ON r.team_id = o.team_id AND a.ts >= r.window_start AND a.ts < r.window_end""",
    "ruled": f"""SELECT *,
  CAST({norm_message('message')} IN {listing(K.GENERIC_MESSAGES)} AS INT) AS r1,
  CAST({norm_message('message')} IN {listing(K.HEARTBEAT_MESSAGES)} AS INT) AS r2,
  CAST({blank('application')} OR {norm_field('application')} IN {BAD} OR {blank('operator')}
    OR {norm_field('operator')} IN {BAD} OR {blank('component')} OR {norm_field('component')} IN {BAD}
    OR (NOT {blank('node_name')} AND {norm_field('node_name')} IN {BAD}) AS INT) AS r3,
  CAST(coalesce({norm_field('provider')}, '') = 'grafana' AND {blank('alert_rule_url')} AS INT) AS r4,
  CASE WHEN alert_schema <> 'v1' THEN NULL WHEN {blank('time_created')} THEN 'missing'
    WHEN try_cast(rtrim(time_created, 'Z') AS TIMESTAMP) IS NULL THEN 'unparseable'
    WHEN try_cast(rtrim(time_created, 'Z') AS TIMESTAMP) > ts THEN 'future'
    WHEN try_cast(rtrim(time_created, 'Z') AS TIMESTAMP) < ts - INTERVAL 24 HOUR THEN 'older_than_24h' END AS r7_reason,
  CASE WHEN alert_schema <> 'v2' THEN NULL WHEN impact IS NULL THEN 'missing' WHEN {blank('impact')} THEN 'empty'
    WHEN {norm_field('impact')} IN {BAD} THEN 'placeholder' END AS r8_reason,
  CASE WHEN alert_schema <> 'v2' THEN NULL WHEN runbook_url IS NULL THEN 'missing' WHEN {blank('runbook_url')} THEN 'empty'
    WHEN {norm_field('runbook_url')} IN {BAD} THEN 'placeholder' WHEN {HOST} = '' THEN 'not_absolute_http' END AS r9_reason,
  CAST(alert_schema = 'v2' AND coalesce({norm_message('impact')}, '') IN {listing(K.TECHNICAL_IMPACTS)} AS INT) AS r10,
  CASE WHEN alert_schema = 'v1' THEN severity = 'clear' ELSE status = 'resolved' END AS is_clear
  FROM scoped""",
    "judged": """SELECT *, CAST(r7_reason IS NOT NULL AS INT) AS r7, CAST(r8_reason IS NOT NULL AS INT) AS r8,
  CAST(r9_reason IS NOT NULL AS INT) AS r9,
  (r1 + r2 + r3 + r4 > 0 OR r7_reason IS NOT NULL) AS core,
  coalesce(node_name = 'test-node', false) AS hit_node,
  coalesce(node_name LIKE 'test%', false) AS hit_like,
  coalesce(application = 'app-2', false) AS hit_app,
  team_id = 'team-b' AND alert_schema = 'v1' AND application NOT IN ('app-0', 'app-1') AS hides_b1,
  (alert_schema = 'v1' OR team_id = 'team-a') AS has_panel
  FROM ruled""",
    # panels: A1 and A2 over team-a v1, A3 over team-a v2, B1 over team-b v1
    "guard": """SELECT run_id, alert_schema, count(*) AS total,
  2 * count(*) FILTER (hit_node) <= count(*) AS node_ok, 2 * count(*) FILTER (hit_like) <= count(*) AS like_ok,
  2 * count(*) FILTER (hit_app) <= count(*) AS app_ok,
  count(*) FILTER (hit_node) AS node_n, count(*) FILTER (hit_like) AS like_n, count(*) FILTER (hit_app) AS app_n
  FROM judged GROUP BY ALL""",
    "seen": """SELECT j.*, CASE
    WHEN team_id = 'team-a' AND j.alert_schema = 'v1' THEN hit_node AND node_ok AND hit_like AND like_ok
    WHEN team_id = 'team-a' THEN hit_app AND app_ok
    WHEN j.alert_schema = 'v1' THEN hit_node AND node_ok ELSE false END AS suppressed
  FROM judged j JOIN guard g ON g.run_id = j.run_id AND g.alert_schema = j.alert_schema""",
    "ordered": f"""SELECT *, epoch_us(ts) AS us,
  sum(CAST(is_clear AS INT)) OVER w - CAST(is_clear AS INT) AS episode,
  is_clear AND NOT coalesce(lag(is_clear) OVER w, true) AS is_cycle,
  row_number() OVER w AS pos
  FROM judged WINDOW w AS (PARTITION BY {ID} ORDER BY ts, is_clear, seq ROWS UNBOUNDED PRECEDING)""",
    "cycles": f"""SELECT {ID}, max(n) AS max_cycles FROM (
  SELECT {ID}, count(*) OVER (PARTITION BY {ID} ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n
  FROM ordered WHERE is_cycle) c GROUP BY ALL""",
    "episodes": f"""SELECT {ID}, episode, count(*) FILTER (NOT is_clear) AS fires,
  min(us) FILTER (NOT is_clear) AS from_us, bool_or(is_clear) AS closed FROM ordered GROUP BY ALL""",
    "reps": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY ts DESC, doc_hash, seq) AS rn FROM judged) r WHERE rn = 1""",
    "firing0": f"""SELECT {ID}, count(*) AS row_count, count(*) FILTER (is_clear) AS clear_count,
  min(us) AS first_us, max(us) AS last_us FROM ordered GROUP BY ALL""",
    "firing": f"""SELECT f.*, coalesce(c.max_cycles, 0) AS max_clear_cycles_24h, e.max_episode_firing_rows, e.open_us,
  f.last_us - f.first_us AS span_us, f.last_us - e.open_us AS open_span_us,
  CASE WHEN f.last_us - f.first_us >= 21600000000 THEN CAST(f.row_count AS DOUBLE) / ((f.last_us - f.first_us) / 86400000000.0::DOUBLE) END AS events_per_24h,
  CASE WHEN coalesce(c.max_cycles, 0) >= 3 THEN 'flapping'
    WHEN p.provider <> 'grafana' AND f.last_us - f.first_us >= 21600000000
      AND CAST(f.row_count AS HUGEINT) * 86400000000 >= 24 * CAST(f.last_us - f.first_us AS HUGEINT) THEN 'spamming'
    WHEN p.provider = 'grafana' AND f.last_us - e.open_us >= 259200000000 THEN 'stuck' END AS fire_pattern
  FROM firing0 f JOIN (SELECT {ID}, CAST(max(fires) AS BIGINT) AS max_episode_firing_rows,
      max(from_us) FILTER (NOT closed) AS open_us FROM episodes GROUP BY ALL) e USING ({ID})
  JOIN reps p USING ({ID}) LEFT JOIN cycles c USING ({ID})""",
    "days": f"""SELECT s.team_id, {', '.join('s.' + x.strip() for x in ID.split(','))}, snapshot_date, count(*) AS n,
  count(*) FILTER (core OR suppressed OR fire_pattern IS NOT NULL) AS flagged,
  count(*) FILTER (suppressed) AS suppressed, count(*) FILTER (hides_b1 AND NOT suppressed) AS unseen,
  bool_or(has_panel) AS has_panel, min(ts) AS first_ts, max(ts) AS last_ts,
  sum(r1) AS r1, sum(r2) AS r2, sum(r3) AS r3, sum(r4) AS r4, count(*) FILTER (suppressed) AS r5,
  count(*) FILTER (fire_pattern IS NOT NULL) AS r6, sum(r7) AS r7, sum(r8) AS r8, sum(r9) AS r9, sum(r10) AS r10
  FROM seen s JOIN firing f USING ({ID}) GROUP BY ALL""",
    "rolled": f"""SELECT team_id, {ID}, sum(n) AS row_count, min(first_ts) AS first_seen, max(last_ts) AS last_seen,
  count(*) AS present_days, bool_or(has_panel) AS has_panel, sum(unseen) AS unseen_rows,
  {', '.join(f'sum({r.lower()}) AS {r.lower()}' for r in K.ALL_RULES)} FROM days GROUP BY ALL""",
    "ids": f"""SELECT d.*, p.message, p.severity, p.component, p.node_name, p.provider, p.alert_rule_url, p.operator,
  p.status, p.impact, p.runbook_url, p.time_created, p.doc_hash, p.ts AS representative_at,
  p.r8 AS g8, p.r9 AS g9, p.r10 AS g10,
  concat_ws(',', {IDS_CORE.replace('r1 >', 'd.r1 >')}) AS core_rule_ids,
  concat_ws(',', CASE WHEN p.r8 > 0 THEN 'R8' END, CASE WHEN p.r9 > 0 THEN 'R9' END, CASE WHEN p.r10 > 0 THEN 'R10' END) AS readiness_rule_ids,
  CASE WHEN has_panel THEN unseen_rows > 0 END AS unseen,
  CASE WHEN d.alert_schema = 'v2' THEN p.r8 = 0 AND p.r10 = 0 AND NOT (p.severity = 'critical' AND p.r9 > 0) END AS ready,
  f.clear_count, f.max_clear_cycles_24h, f.max_episode_firing_rows, f.open_us, f.open_span_us, f.span_us, f.events_per_24h, f.fire_pattern
  FROM rolled d JOIN (SELECT * EXCLUDE (r1, r2, r3, r4, r7, team_id, has_panel) FROM reps) p USING ({ID})
  JOIN (SELECT * EXCLUDE (row_count) FROM firing) f USING ({ID})""",
    "buckets": """SELECT run_id, team_id, d AS snapshot_date, greatest(window_start, d) AS bucket_start,
  least(window_end, d + INTERVAL 1 DAY) AS bucket_end,
  (epoch_us(least(window_end, d + INTERVAL 1 DAY)) - epoch_us(greatest(window_start, d))) / 3600000000.0::DOUBLE AS covered_hours
  FROM (SELECT *, CAST(unnest(generate_series(CAST(CAST(window_start AS DATE) AS TIMESTAMP),
    CAST(CAST(window_end - INTERVAL 1 MICROSECOND AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS TIMESTAMP) AS d FROM runs) r""",
    "volume": f"""SELECT b.run_id, b.team_id, s.alert_schema, CAST(b.snapshot_date AS DATE) AS snapshot_date, bucket_start, bucket_end, covered_hours,
  coalesce(alerts, 0) AS alerts, coalesce(distinct_alerts, 0) AS distinct_alerts,
  coalesce(alerts, 0) / covered_hours AS alerts_per_hour,
  coalesce(nn, 0) AS node_name_numerator, coalesce(nd, 0) AS node_name_denominator,
  CASE WHEN nd > 0 THEN CAST(nn AS DOUBLE) / nd END AS node_name_ratio,
  coalesce(distinct_alerts, 0) AS key_inflation_numerator, coalesce(kd, 0) AS key_inflation_denominator,
  CASE WHEN kd > 0 THEN CAST(distinct_alerts AS DOUBLE) / kd END AS key_inflation_ratio
  FROM buckets b CROSS JOIN (VALUES ('v1'), ('v2')) s(alert_schema) LEFT JOIN (
    SELECT run_id, alert_schema, snapshot_date, count(*) AS alerts, count(DISTINCT (application, key_field)) AS distinct_alerts,
      count(DISTINCT (application, coalesce(component, ''))) AS kd,
      count(DISTINCT (application, coalesce(component, ''), node_name)) FILTER (NOT {blank('node_name')}) AS nn,
      count(DISTINCT (application, coalesce(component, ''))) FILTER (NOT {blank('node_name')}) AS nd
    FROM scoped GROUP BY ALL) x ON x.run_id = b.run_id AND x.alert_schema = s.alert_schema AND x.snapshot_date = CAST(b.snapshot_date AS DATE)""",
    "rule_days": "SELECT team_id, run_id, alert_schema, snapshot_date, rule_id, sum(m) AS match_count, count(*) AS distinct_count FROM ("
    + " UNION ALL ".join(
        f"SELECT team_id, run_id, alert_schema, snapshot_date, '{r}' AS rule_id, {r.lower()} AS m FROM days WHERE {r.lower()} > 0"
        for r in K.ALL_RULES
    )
    + ") x GROUP BY ALL",
    "unmeasured": """SELECT r.run_id, s.alert_schema,
  CASE WHEN r.team_id = 'team-a' AND s.alert_schema = 'v1' THEN CAST(NOT coalesce(node_ok, true) AS INT) + CAST(NOT coalesce(like_ok, true) AS INT)
       WHEN r.team_id = 'team-a' THEN CAST(NOT coalesce(app_ok, true) AS INT) WHEN s.alert_schema = 'v1' THEN CAST(NOT coalesce(node_ok, true) AS INT) END AS u,
  CASE WHEN r.team_id = 'team-a' THEN 0 WHEN s.alert_schema = 'v1' THEN 1 END AS iu
  FROM runs r CROSS JOIN (VALUES ('v1'), ('v2')) s(alert_schema)
  LEFT JOIN guard g ON g.run_id = r.run_id AND g.alert_schema = s.alert_schema""",
    # ------------------------------------------------------------ classifier
    "eligible": f"""SELECT *, {stable_hash({'schema': enc('alert_schema'), 'application': enc('application'), 'key_field': enc('key_field')})} AS alert_id,
  CASE WHEN {blank('alert_rule_url')} THEN 'application' ELSE 'alert_rule_url' END AS group_type,
  CASE WHEN {blank('alert_rule_url')} THEN application ELSE alert_rule_url END AS group_value
  FROM ids WHERE core_rule_ids = ''""",
    # a round asks about each key in the first week that is left of it; see ``_round``
    "left_0": "SELECT e.*, r.window_end FROM eligible e JOIN runs r ON r.run_id = e.run_id",
    **{name: text for k in range(ROUNDS) for name, text in _round(k).items()},
    **{
        name: " UNION ALL BY NAME ".join(f"SELECT * FROM {name}_{k}" for k in range(ROUNDS))
        for name in ("placed", "batches", "answered", "again")
    },
    "outcomes": f"""SELECT {ID}, batch_id, alert_id, group_value, reused,
  CASE WHEN lost THEN 'unassessed' ELSE ['assessed_good', 'llm_flagged', 'needs_review', 'needs_review', 'assessed_good'][pick + 1] END AS state,
  CASE WHEN NOT lost THEN ['no_violation', 'catalog_violation', 'catalog_violation', 'other', 'no_violation'][pick + 1] END AS assessment,
  CASE WHEN NOT lost THEN ['NONE', 'P3', 'P6', 'OTHER', 'NONE'][pick + 1] END AS principle_id,
  CASE WHEN NOT lost THEN ['high', 'high', 'medium', 'low', 'medium'][pick + 1] END AS confidence
  FROM (SELECT *, false AS reused FROM answered UNION ALL BY NAME SELECT *, true AS reused, false AS lost FROM again) x""",
    # ------------------------------------------------------------ facts
    "findings": f"""SELECT i.*, CASE WHEN core_rule_ids <> '' THEN 'rule_flagged' ELSE coalesce(o.state, 'unassessed') END AS quality_state,
  o.principle_id AS llm_principle_id, o.confidence AS llm_confidence,
  CASE WHEN o.state = 'unassessed' THEN 'batch exhausted 3 attempts - timeout: scripted timeout' END AS unassessed_reason
  FROM ids i LEFT JOIN outcomes o USING ({ID})""",
    "quality_days": """SELECT d.run_id, d.alert_schema, d.snapshot_date,
  sum(CASE WHEN quality_state = 'llm_flagged' THEN n ELSE 0 END) AS flagged_by_llm,
  count(*) FILTER (quality_state = 'llm_flagged') AS flagged_by_llm_distinct,
  count(*) FILTER (quality_state = 'needs_review') AS needs_review,
  count(*) FILTER (quality_state = 'assessed_good') AS assessed_good,
  count(*) FILTER (quality_state = 'unassessed') AS unassessed,
  count(*) FILTER (d.alert_schema = 'v2' AND readiness_rule_ids <> '') AS phase2_gaps,
  sum(flagged) AS flagged_by_rule, count(*) FILTER (flagged > 0) AS flagged_by_rule_distinct,
  sum(d.suppressed) AS suppressed, sum(d.unseen) AS unseen
  FROM days d JOIN (SELECT run_id, alert_schema, application, key_field, quality_state, readiness_rule_ids FROM findings) f
  USING (run_id, alert_schema, application, key_field) GROUP BY ALL""",
    "metrics": """SELECT v.*, CAST(coalesce(flagged_by_rule, 0) AS BIGINT) AS flagged_by_rule, coalesce(flagged_by_rule_distinct, 0) AS flagged_by_rule_distinct,
  CAST(coalesce(flagged_by_llm, 0) AS BIGINT) AS flagged_by_llm, coalesce(flagged_by_llm_distinct, 0) AS flagged_by_llm_distinct,
  coalesce(needs_review, 0) AS needs_review, coalesce(assessed_good, 0) AS assessed_good, coalesce(unassessed, 0) AS unassessed,
  coalesce(phase2_gaps, 0) AS phase2_gaps, CAST(coalesce(suppressed, 0) AS BIGINT) AS suppressed,
  CASE WHEN row_number() OVER (PARTITION BY v.run_id, v.alert_schema ORDER BY v.snapshot_date) = 1 THEN coalesce(u, 0) ELSE 0 END AS suppression_unmeasured,
  CASE WHEN u IS NOT NULL THEN CAST(coalesce(unseen, 0) AS BIGINT) END AS unseen,
  CASE WHEN u IS NOT NULL THEN CASE WHEN row_number() OVER (PARTITION BY v.run_id, v.alert_schema ORDER BY v.snapshot_date) = 1 THEN iu ELSE 0 END END AS unseen_unmeasured
  FROM volume v LEFT JOIN quality_days x USING (run_id, alert_schema, snapshot_date)
  LEFT JOIN unmeasured m USING (run_id, alert_schema)""",
    "run_facts": """SELECT r.*, coalesce(v1, 0) AS v1_identities, coalesce(v2, 0) AS v2_identities, pct AS phase2_readiness_pct,
  coalesce(gaps, 0) AS phase2_gap_identities, coalesce(eligible_n, 0) AS llm_eligible,
  CASE WHEN coalesce(v1, 0) = 0 AND coalesce(v2, 0) = 0 THEN 'no_data' WHEN coalesce(v2, 0) = 0 THEN 'phase_0' WHEN v1 > 0 THEN 'phase_1'
    WHEN pct >= 100 THEN 'done' ELSE 'phase_2' END AS phase_derived
  FROM runs r LEFT JOIN (SELECT run_id, count(*) FILTER (alert_schema = 'v1') AS v1, count(*) FILTER (alert_schema = 'v2') AS v2,
    CASE WHEN count(*) FILTER (alert_schema = 'v2') > 0 THEN CAST(count(*) FILTER (ready) AS DOUBLE) / count(*) FILTER (alert_schema = 'v2') * 100 END AS pct,
    count(*) FILTER (alert_schema = 'v2' AND readiness_rule_ids <> '') AS gaps, count(*) FILTER (core_rule_ids = '') AS eligible_n
    FROM ids GROUP BY run_id) x USING (run_id)""",
    # ------------------------------------------------------------ published weeks
    "pubs": """SELECT run_id, team_id, window_start, window_end, window_end + INTERVAL 6 HOUR - (CASE copy WHEN 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) AS published_at,
  CASE WHEN copy = 0 THEN window_end + INTERVAL 6 HOUR WHEN team_id = 'team-b' AND window_end = TIMESTAMP '2024-01-15' THEN window_end + INTERVAL 30 HOUR END AS withdrawn_at,
  CAST(datediff('day', DATE '2024-01-08', CAST(window_end AS DATE)) / 7 * 4 + CASE team_id WHEN 'team-a' THEN 0 ELSE 2 END + copy + 1 AS BIGINT) AS publication_id
  FROM runs, (VALUES (0), (1)) c(copy) WHERE copy = 1 OR (team_id = 'team-a' AND window_end = TIMESTAMP '2024-01-15')""",
    "basis": """SELECT run_id, sha256(coalesce(CAST(registry_entry_snapshot->'$.v1_operators' AS VARCHAR), '-') || '|' || coalesce(CAST(registry_entry_snapshot->'$.panels' AS VARCHAR), '-') || '|' || coalesce('"' || (registry_entry_snapshot->>'$.v2_operator'), '-')) AS basis,
  TRY_CAST(registry_entry_snapshot->>'$.planning.v1_rule_effort_days' AS DECIMAL(6,2)) AS v1_rule_effort_days FROM runs""",
    "weeks": """SELECT publication_id, r.team_id, team_display_name, r.run_id, r.window_start, r.window_end, published_at, phase_derived, phase2_readiness_pct,
  coalesce(lag(ruleset_version) OVER w <> ruleset_version OR lag(basis) OVER w <> basis, false) AS basis_changed, v1_rule_effort_days
  FROM pubs p JOIN run_facts r USING (run_id) JOIN basis b USING (run_id) WHERE withdrawn_at IS NULL
  WINDOW w AS (PARTITION BY r.team_id ORDER BY r.window_end)""",
    "ranked": """SELECT *, CASE quality_state WHEN 'rule_flagged' THEN 0 WHEN 'llm_flagged' THEN 1 WHEN 'needs_review' THEN 2
  ELSE CASE WHEN readiness_rule_ids <> '' THEN 3 ELSE 4 END END AS attention_rank,
  trim(core_rule_ids || ',' || readiness_rule_ids, ',') AS all_ids FROM findings""",
    "palerts": "SELECT * FROM ranked WHERE run_id IN (SELECT run_id FROM weeks)",
    "totals": """SELECT w.run_id, s.alert_schema, CAST(coalesce(events, 0) AS BIGINT) AS events, CAST(coalesce(flagged_rows, 0) AS BIGINT) AS flagged_rows,
  CAST(coalesce(d.suppressed, 0) AS BIGINT) AS suppressed, CAST(d.unseen AS BIGINT) AS unseen, coalesce(distinct_alerts, 0) AS distinct_alerts,
  coalesce(rule_flagged, 0) AS rule_flagged, coalesce(llm_flagged, 0) AS llm_flagged, coalesce(needs_review, 0) AS needs_review,
  coalesce(assessed_good, 0) AS assessed_good, coalesce(unassessed, 0) AS unassessed, coalesce(readiness_gaps, 0) AS readiness_gaps,
  coalesce(needs_attention, 0) AS needs_attention, CAST(unseen_alerts AS BIGINT) AS unseen_alerts, coalesce(r6_alerts, 0) AS r6_alerts
  FROM weeks w CROSS JOIN (VALUES ('v1'), ('v2')) s(alert_schema)
  LEFT JOIN (SELECT run_id, alert_schema, sum(alerts) AS events, sum(flagged_by_rule) AS flagged_rows, sum(suppressed) AS suppressed, sum(unseen) AS unseen
    FROM metrics GROUP BY ALL) d ON d.run_id = w.run_id AND d.alert_schema = s.alert_schema
  LEFT JOIN (SELECT run_id, alert_schema, count(*) AS distinct_alerts, count(*) FILTER (quality_state = 'rule_flagged') AS rule_flagged,
    count(*) FILTER (quality_state = 'llm_flagged') AS llm_flagged, count(*) FILTER (quality_state = 'needs_review') AS needs_review,
    count(*) FILTER (quality_state = 'assessed_good') AS assessed_good, count(*) FILTER (quality_state = 'unassessed') AS unassessed,
    count(*) FILTER (readiness_rule_ids <> '') AS readiness_gaps, count(*) FILTER (attention_rank < 4) AS needs_attention,
    sum(CAST(unseen AS INT)) AS unseen_alerts, count(*) FILTER (fire_pattern IS NOT NULL) AS r6_alerts FROM ranked GROUP BY ALL) f
    ON f.run_id = w.run_id AND f.alert_schema = s.alert_schema""",
    "carried": "SELECT *, unnest(string_split(all_ids, ',')) AS rule_id FROM ranked WHERE all_ids <> ''",
    "rtotals": """SELECT e.*, coalesce(alerts, 0) AS alerts FROM (SELECT run_id, alert_schema, rule_id, CAST(sum(match_count) AS BIGINT) AS events FROM rule_days
  WHERE run_id IN (SELECT run_id FROM weeks) GROUP BY ALL) e LEFT JOIN (SELECT run_id, alert_schema, rule_id, count(*) AS alerts FROM carried GROUP BY ALL) c
  USING (run_id, alert_schema, rule_id)""",
    "decisions": """SELECT ('0x' || substr(sha256(concat_ws('|', run_id, alert_schema, application, key_field, rule_id, CAST(round AS VARCHAR))), 1, 12))::BIGINT AS decision_id,
  team_id, run_id, alert_schema, application, key_field, rule_id AS finding_id, ['pending', 'confirmed', 'dismissed'][CAST((row_count + round) % 3 + 1 AS INT)] AS state,
  'round ' || round AS note, last_seen + (round + 1) * INTERVAL 1 DAY AS decided_at
  FROM carried, (VALUES (0), (1)) r(round) WHERE round = 0 OR row_count % 2 = 0""",
    "pdecisions": "SELECT * FROM decisions WHERE run_id IN (SELECT run_id FROM weeks)",
    "health": """SELECT r.run_id, r.team_id, r.window_end, coalesce(u, 0) AS unassessed,
  CASE WHEN u > 0 THEN u || ' alert(s) were not assessed by the model' END AS problems
  FROM runs r LEFT JOIN (SELECT run_id, count(*) AS u FROM findings WHERE quality_state = 'unassessed' GROUP BY 1) x USING (run_id)""",
    "schedule": """SELECT *, CASE WHEN problems IS NOT NULL THEN 'held' WHEN coalesce(max(CAST(problems IS NOT NULL AS INT)) OVER
    (PARTITION BY team_id ORDER BY window_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'stored' ELSE 'published' END AS outcome,
  CAST(datediff('day', DATE '2024-01-08', CAST(window_end AS DATE)) / 7 * 2 + CASE team_id WHEN 'team-a' THEN 1 ELSE 2 END AS BIGINT) AS log_id,
  window_end + INTERVAL 5 HOUR AS invoked_at FROM health""",
    "week_keys": """SELECT DISTINCT w.team_id, f.run_id, w.window_end,
  CASE WHEN trim(coalesce(alert_rule_url, '')) <> '' THEN 'url:' || trim(alert_rule_url) ELSE 'app:' || application END AS rule_key
  FROM ranked f JOIN weeks w ON w.run_id = f.run_id WHERE alert_schema = 'v1'""",
    "history": """SELECT a.team_id, a.run_id, a.window_end, b.run_id AS past_run_id, b.window_end AS past_end, b.basis_changed AS past_basis_changed, a.n - b.n AS age
  FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY window_end) AS n FROM weeks) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY window_end) AS n FROM weeks) b ON a.team_id = b.team_id AND b.n <= a.n AND b.n > a.n - 4""",
    "effort": """SELECT w.run_id, w.team_id, w.window_end, coalesce(rules_left, 0) AS rules_left, coalesce(CAST(v1_rule_effort_days AS DOUBLE), 0.5) AS effort_days_per_rule,
  v1_rule_effort_days IS NOT NULL AS effort_is_override FROM weeks w LEFT JOIN (SELECT run_id, count(*) AS rules_left FROM week_keys GROUP BY 1) x USING (run_id)""",
    # ------------------------------------------------------------ annotated cases
    "cases": f"""SELECT i.run_id, i.alert_schema, i.application, i.key_field, i.provider, i.severity, i.alert_rule_url, o.state, o.principle_id, o.confidence,
  o.alert_id AS case_id, 'fam-' || (instr('0123456789abcdef', substr(o.alert_id, 3, 1)) - 1) AS family,
  CASE WHEN (instr('0123456789abcdef', substr(o.alert_id, 4, 1)) - 1) % 2 = 0 THEN 'development' ELSE 'holdout' END AS split,
  ['NONE', 'P3,P6', 'R2,P1', 'OTHER', 'NONE,P1'][(instr('0123456789abcdef', substr(o.alert_id, 2, 1)) - 1) % 5 + 1] AS expected_principles,
  ['high', 'high,medium', 'low', 'sure'][(instr('0123456789abcdef', substr(o.alert_id, 3, 1)) - 1) % 4 + 1] AS expected_confidences,
  CASE WHEN substr(o.alert_id, 5, 1) = '0' THEN ' ' ELSE 'because' END AS rationale,
  (instr('0123456789abcdef', substr(o.alert_id, 6, 1)) - 1) AS digit
  FROM ids i JOIN outcomes o USING ({ID})""",
    "scored": """SELECT *, expected_principles <> 'NONE' AS expected_violation,
  coalesce(list_contains(string_split(expected_principles, ','), principle_id), false) AS citation_correct,
  coalesce(list_contains(string_split(expected_confidences, ','), confidence), false) AS confidence_correct,
  state = 'llm_flagged' AS high_catalogue, expected_principles <> 'NONE' AND state = 'assessed_good' AS missed_as_good,
  CASE WHEN coalesce(alert_rule_url, '') <> '' THEN 'url:' || alert_rule_url ELSE 'app:' || application END AS group_key FROM cases""",
}
RATES = """count(*) AS cases, count(*) FILTER (high_catalogue) AS high_findings,
  CAST(count(*) FILTER (high_catalogue AND citation_correct) AS DOUBLE) / nullif(count(*) FILTER (high_catalogue), 0) AS high_precision,
  count(*) FILTER (expected_violation) AS known_violations, count(*) FILTER (missed_as_good) AS missed_as_good,
  CAST(count(*) FILTER (missed_as_good) AS DOUBLE) / nullif(count(*) FILTER (expected_violation), 0) AS missed_as_good_rate,
  count(*) FILTER (state = 'unassessed') AS unassessed,
  CAST(count(*) FILTER (citation_correct) AS DOUBLE) / nullif(count(*), 0) AS citation_accuracy,
  CAST(count(*) FILTER (confidence_correct) AS DOUBLE) / nullif(count(*), 0) AS confidence_accuracy"""

KINDS = {
    # one window over eight dates, the narrow projection
    "window": (None, sample.window_specs),
    # the same window with more identities
    "wide": (sample.FAN, sample.window_specs),
    # four published weeks of both teams
    "weekly": (sample.FAN, sample.weekly_specs),
}


def sql(final: str, kind: str = "window", **extra: str) -> str:
    fan, specs = KINDS[kind]
    parts = {
        "proj": PROJECTION.replace("{key}", key_expression(fan)),
        "runs": runs_sql(specs()),
        **PARTS,
        **extra,
    }
    names = set(parts)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b(?:FROM|JOIN|IN \(SELECT run_id FROM|,)\s+([a-z_0-9]+)\b", text)) & names:
            if name not in needed:
                needed.add(name)
                visit(parts[name])

    visit(final)
    ordered = [n for n in parts if n in needed]
    # a part may use one listed later; order by dependency
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in ordered:
            if other != name and re.search(rf"\b(?:FROM|JOIN|,)\s+{other}\b", parts[name]):
                place(other)
        done.append(name)

    for name in ordered:
        place(name)
    body = ",\n".join(f"{n} AS MATERIALIZED (\n{parts[n]}\n)" for n in done)
    return f"WITH {body}\n{final}" if body else final


__all__ = ["NOW", "RATES", "ID", "sql"]
