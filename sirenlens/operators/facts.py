"""Writing facts: replace a run, insert if absent, CSV exports, and the invariants checked
before every write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.instants import iso_instant
from sirenlens.functions.text import rule_number
from sirenlens.operators.published import current_publications
from sirenlens.session import materialize

c = F.col
# counters whose absence means a counted zero
ZERO_DEFAULTS = ("clear_count", "max_clear_cycles_24h", "max_episode_firing_rows")

# --- fixed values: CSV headers, (header, column)
DAILY_HEADERS = (
    ("run_id", "run_id"),
    ("team_id", "team_id"),
    ("schema", "alert_schema"),
    ("snapshot_date", "snapshot_date"),
    ("bucket_start", "bucket_start"),
    ("bucket_end", "bucket_end"),
    ("covered_hours", "covered_hours"),
    ("alerts", "alerts"),
    ("distinct_alerts", "distinct_alerts"),
    ("alerts_per_hour", "alerts_per_hour"),
    ("node_name_numerator", "node_name_numerator"),
    ("node_name_denominator", "node_name_denominator"),
    ("node_name_ratio", "node_name_ratio"),
    ("key_inflation_numerator", "key_inflation_numerator"),
    ("key_inflation_denominator", "key_inflation_denominator"),
    ("key_inflation_ratio", "key_inflation_ratio"),
    ("flagged_by_rule", "flagged_by_rule"),
    ("flagged_by_rule_distinct", "flagged_by_rule_distinct"),
    ("flagged_by_llm", "flagged_by_llm"),
    ("flagged_by_llm_distinct", "flagged_by_llm_distinct"),
    ("needs_review", "needs_review"),
    ("assessed_good", "assessed_good"),
    ("unassessed", "unassessed"),
    ("phase2_gaps", "phase2_gaps"),
    ("suppressed", "suppressed"),
    ("suppression_unmeasured", "suppression_unmeasured"),
    ("unseen", "unseen"),
    ("unseen_unmeasured", "unseen_unmeasured"),
)
RULE_HEADERS = (
    ("run_id", "run_id"),
    ("team_id", "team_id"),
    ("schema", "alert_schema"),
    ("snapshot_date", "snapshot_date"),
    ("rule_id", "rule_id"),
    ("ruleset_version", "ruleset_version"),
    ("match_count", "match_count"),
    ("distinct_count", "distinct_count"),
)
WORKLIST_HEADERS = (
    ("run_id", "run_id"),
    ("schema", "alert_schema"),
    ("application", "application"),
    ("key_field", "key_field"),
    ("quality_state", "quality_state"),
    ("core_rule_ids", "core_rule_ids"),
    ("readiness_rule_ids", "readiness_rule_ids"),
    ("llm_principle_id", "llm_principle_id"),
    ("llm_confidence", "llm_confidence"),
    ("llm_justification", "llm_justification"),
    ("unassessed_reason", "unassessed_reason"),
    ("row_count", "row_count"),
    ("first_seen", "first_seen"),
    ("last_seen", "last_seen"),
    ("severity", "severity"),
    ("component", "component"),
    ("node_name", "node_name"),
    ("environment", "environment"),
    ("provider", "provider"),
    ("alert_rule_url", "alert_rule_url"),
    ("message", "message"),
    ("clear_count", "clear_count"),
    ("max_clear_cycles_24h", "max_clear_cycles_24h"),
    ("fire_pattern", "fire_pattern"),
    ("unseen", "unseen"),
    ("max_episode_firing_rows", "max_episode_firing_rows"),
    ("open_since", "open_since"),
)
# stored precision of derived rates
RATE_TYPES = {
    "covered_hours": "decimal(6,3)",
    "alerts_per_hour": "decimal(18,6)",
    "node_name_ratio": "decimal(18,6)",
    "key_inflation_ratio": "decimal(18,6)",
    "phase2_readiness_pct": "decimal(9,6)",
}


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the declared columns (name to type): absent ones are NULL, or 0 for a counter."""
    chosen = []
    for name, kind in columns.items():
        value = c(name) if name in df.columns else F.lit(None)
        if name in ZERO_DEFAULTS:
            value = F.coalesce(value, F.lit(0))
        chosen.append(value.cast(kind).alias(name))
    return df.select(*chosen)


def stored_rates(df: DataFrame) -> DataFrame:
    """Derived rates at their stored precision."""
    return df.withColumns({n: c(n).cast(t) for n, t in RATE_TYPES.items() if n in df.columns})


def refuse_published(runs: DataFrame, publications: DataFrame) -> DataFrame:
    """Runs that are currently published and so may not be replaced."""
    return runs.join(current_publications(publications).select("run_id"), "run_id", "left_semi")


def replace_runs(df: DataFrame, path: str, publications: DataFrame | None = None) -> None:
    """Replace the rows of the runs in ``df`` and touch no other run: one dynamic partition
    overwrite, so a retried job writes the same result."""
    if publications is not None:
        blocked = refuse_published(df.select("run_id").distinct(), publications).limit(1).count()
        if blocked:
            raise ValueError("a published run may not be replaced; withdraw it first")
    (
        # gathers a run's rows into few files, and still splits a run that is too big for one task
        df.hint("rebalance", "run_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key; the stored row always wins, and of
    several new rows the first in order of all their values."""
    others = [n for n in new.columns if n not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*keys, "_row.*")
    return one.select(new.columns).join(existing.select(*keys), keys, "left_anti")


def insert_absent(new: DataFrame, path: str, keys: list[str]) -> None:
    existing = new.sparkSession.read.parquet(path)
    absent(new, existing, keys).write.mode("append").parquet(path)


# ------------------------------------------------------------------ CSV


def csv_text(name: str, kind: str) -> Column:
    """One CSV cell: instants with milliseconds, lowercase booleans, plain decimals, and a quote
    in front of anything a spreadsheet would run as a formula."""
    value = c(name)
    if kind == "timestamp":
        text = iso_instant(value)
    elif kind.startswith("decimal"):
        text = F.regexp_replace(
            F.regexp_replace(value.cast("string"), r"(\.\d*?)0+\z", "$1"), r"\.\z", ""
        )
    else:
        text = value.cast("string")
    safe = F.when(text.rlike(r"\A[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.coalesce(safe, F.lit(""))


def csv_rows(df: DataFrame, headers: tuple[tuple[str, str], ...]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[csv_text(col, kinds[col]).alias(header) for header, col in headers])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with CRLF line ends and quotes only where needed. Ordering is the caller's: rows are
    range-sorted, so part files concatenate in order at any size."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("lineSep", "\r\n")
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def daily_metrics_csv(metrics: DataFrame) -> DataFrame:
    ordered = stored_rates(metrics).orderBy("run_id", "alert_schema", "snapshot_date")
    return csv_rows(ordered, DAILY_HEADERS)


def rule_counts_csv(counts: DataFrame) -> DataFrame:
    ordered = counts.orderBy("run_id", "alert_schema", "snapshot_date", rule_number(c("rule_id")))
    return csv_rows(ordered, RULE_HEADERS)


def worklist_csv(findings: DataFrame) -> DataFrame:
    return csv_rows(
        findings.orderBy("run_id", "alert_schema", "application", "key_field"), WORKLIST_HEADERS
    )


# ------------------------------------------------------------------ invariants

RULES: dict[str, dict[str, str]] = {
    "runs": {
        "window": "window_end > window_start",
        "phase": "phase_derived IN ('no_data','phase_0','phase_1','phase_2','done')",
        "status": "status IN ('running','completed','failed')",
        "readiness": "phase2_readiness_pct IS NULL OR phase2_readiness_pct BETWEEN 0 AND 100",
    },
    "daily_metrics": {
        "schema": "alert_schema IN ('v1','v2')",
        "bucket": "bucket_end > bucket_start",
        "covered": "covered_hours > 0 AND covered_hours <= 24",
        "distinct": "distinct_alerts <= alerts",
        "suppressed": "suppressed <= flagged_by_rule",
        "unseen": "unseen IS NULL OR unseen >= 0",
        "visibility": "suppressed + coalesce(unseen, 0) <= alerts",
    },
    "daily_rule_counts": {
        "schema": "alert_schema IN ('v1','v2')",
        "distinct": "distinct_count <= match_count",
    },
    "alert_findings": {
        "schema": "alert_schema IN ('v1','v2')",
        "state": "quality_state IN ('rule_flagged','llm_flagged','needs_review','assessed_good','unassessed')",
        "confidence": "llm_confidence IS NULL OR llm_confidence IN ('high','medium','low')",
        "unassessed": "quality_state <> 'unassessed' OR unassessed_reason IS NOT NULL",
        "pattern": "fire_pattern IS NULL OR fire_pattern IN ('stuck','spamming','flapping')",
        "cycles": "clear_count >= 0 AND max_clear_cycles_24h >= 0 AND max_clear_cycles_24h <= clear_count",
        "episode": "max_episode_firing_rows >= 0",
    },
    "llm_batch_attempts": {
        "number": "attempt_number BETWEEN 1 AND 3",
        "size": "alert_count BETWEEN 1 AND 200",
        "group": "group_type IN ('alert_rule_url','application')",
    },
    "llm_verdicts": {
        "assessment": "assessment IN ('no_violation','catalog_violation','other')",
        "confidence": "confidence IN ('high','medium','low')",
        "pairing": "(assessment = 'no_violation' AND principle_id = 'NONE') OR "
        "(assessment = 'other' AND principle_id = 'OTHER') OR "
        "(assessment = 'catalog_violation' AND principle_id NOT IN ('NONE','OTHER'))",
        "justification": "length(trim(justification)) > 0",
    },
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """Offending rows of a fact table, one per broken rule: ``(table, rule, <row>)``. A NULL
    outcome passes, as a CHECK does."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(name))
                for name, rule in RULES[table].items()
            ]
        )
    )
    return df.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), "*")


def violation_counts(df: DataFrame, table: str) -> DataFrame:
    """Every rule of a table with how many rows were checked and how many break it."""
    checks = F.array(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                (~F.coalesce(F.expr(rule), F.lit(True))).cast("int").alias("bad"),
            )
            for name, rule in RULES[table].items()
        ]
    )
    return (
        df.select(F.inline(checks))
        .groupBy("rule")
        .agg(F.count("*").alias("checked"), F.sum("bad").alias("broken"))
        .select(F.lit(table).alias("table"), "rule", "checked", "broken")
    )


def require_valid(df: DataFrame, table: str) -> DataFrame:
    """Fail before the write when any row breaks an invariant."""
    bad = violations(df, table).limit(1).collect()
    if bad:
        raise ValueError(f"{table} breaks its rule {bad[0]['rule']!r}")
    return df


# ------------------------------------------------------------------ reconciliation

TOLERANCE = 5e-7


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Compare two tables of ``keys + (figure, value)``. A difference above half a unit of the
    stored precision, a missing figure or an unexpected extra is not ``ok``."""
    wanted = expected.select(*keys, "figure", c("value").cast("double").alias("expected"),
                             F.lit(True).alias("is_expected"))
    found = actual.select(*keys, "figure", c("value").cast("double").alias("actual"),
                          F.lit(True).alias("is_found"))
    joined = wanted.join(found, [*keys, "figure"], "full_outer")
    close = F.abs(c("expected") - c("actual")) <= TOLERANCE
    both_null = c("expected").isNull() & c("actual").isNull()
    status = (
        F.when(c("is_found").isNull(), "missing")
        .when(c("is_expected").isNull(), "unexpected")
        .when(both_null | F.coalesce(close, F.lit(False)), "ok")
        .otherwise("different")
    )
    return joined.select(*keys, "figure", "expected", "actual", status.alias("status"))


def figures(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Unpivot named columns to ``keys + (figure, value)``."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("figure"), c(n).cast("double").alias("value")) for n in names]
    )
    return df.select(*keys, F.inline(pairs))


def digests(figures_: DataFrame, keys: list[str], of: list[str]) -> DataFrame:
    """``of, rows, digest``: an order-free sum of row hashes, exact, for the figures of each ``of``."""
    row = F.xxhash64(*keys, "figure", F.round(c("value"), 6)).cast("decimal(38,0)")
    return figures_.groupBy(*of).agg(F.count("*").alias("rows"), F.sum(row).alias("digest"))


def reconcile_by_digest(
    expected: DataFrame, actual: DataFrame, keys: list[str], of: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``(summary, differences)``: figures meet row by row only where the digests of their ``of`` differ.

    ``of`` are the first of ``keys``, such as table and run. The summary has ``expected_rows``,
    ``found_rows`` and whether all is ``equal`` within the tolerance; rounding that moves a digest but no
    figure is equal. The differences are the rows that are not ``ok``.
    """
    wanted = digests(expected, keys, of).withColumnsRenamed({"rows": "expected_rows", "digest": "wanted"})
    found = digests(actual, keys, of).withColumnsRenamed({"rows": "found_rows", "digest": "found"})
    both = wanted.join(found, of, "full_outer").fillna(0, ["expected_rows", "found_rows"])
    both = materialize(both.withColumn("alike", c("wanted").eqNullSafe(c("found"))), "figure-digests")
    suspect = both.where(~c("alike")).select(*of)
    compared = reconcile(expected.join(suspect, of, "left_semi"), actual.join(suspect, of, "left_semi"), keys)
    bad = materialize(compared.where("status <> 'ok'"), "figure-differences")
    kinds = [F.count_if(c("status") == k).alias(k) for k in ("missing", "unexpected", "different")]
    counted = bad.groupBy(*of).agg(*kinds)
    summary = both.join(counted, of, "left").fillna(0, ["missing", "unexpected", "different"])
    equal = (c("missing") + c("unexpected") + c("different")) == 0
    return summary.select(*of, "expected_rows", "found_rows", "missing", "unexpected", "different", equal.alias("equal")), bad


FIGURE_KEYS = ["table", "run_id", "alert_schema", "item"]
DAY_FIGURES = (
    "alerts", "distinct_alerts", "alerts_per_hour", "flagged_by_rule", "flagged_by_llm", "needs_review",
    "assessed_good", "unassessed", "suppressed", "unseen",
)


def fact_figures(daily_metrics: DataFrame, rule_counts: DataFrame, findings: DataFrame) -> DataFrame:
    """Every figure that a published week is checked by: of days, of rules and of states."""
    days = daily_metrics.withColumn("item", F.date_format("snapshot_date", "yyyy-MM-dd"))
    rules = rule_counts.groupBy("run_id", "alert_schema", c("rule_id").alias("item")).agg(
        F.sum("match_count").alias("match_count"), F.sum("distinct_count").alias("distinct_count")
    )
    states = findings.groupBy("run_id", "alert_schema", c("quality_state").alias("item")).agg(F.count("*").alias("alerts"))
    named = (("days", days, DAY_FIGURES), ("rules", rules, ("match_count", "distinct_count")), ("states", states, ("alerts",)))
    parts = [figures(df.withColumn("table", F.lit(t)), FIGURE_KEYS, list(names)) for t, df, names in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def state_partition(findings: DataFrame) -> DataFrame:
    """Identity states must partition the work list: per run, total against the sum of states."""
    return findings.groupBy("run_id").agg(
        F.count("*").alias("worklist"),
        *[F.count_if(c("quality_state") == q).alias(q) for q in K.QUALITY_STATES],
    ).withColumn("states_total", sum((c(q) for q in K.QUALITY_STATES[1:]), c(K.QUALITY_STATES[0])))
