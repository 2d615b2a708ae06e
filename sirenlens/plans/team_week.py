"""The complete week of every team as one job: alerts in, fact tables out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.operators import classify as L
from sirenlens.operators import episodes as E
from sirenlens.operators import identity as I
from sirenlens.operators import rowfacts as R
from sirenlens.operators import suppression as V
from sirenlens.operators import volume as D
from sirenlens.operators.completeness import ObservedScan
from sirenlens.operators.rules import phase_of
from sirenlens.operators.window import day_buckets, scope_alerts
from sirenlens.session import materialize, together
from sirenlens.sources.registry import Registry
from sirenlens.sources.schema import IDENTITY

c = F.col
ID = list(IDENTITY)


class Analysis:
    """Deterministic results of every run in ``runs``, before the classifier: rules, panels,
    episodes and identities. Each step is planned when it is first asked for.

    With ``cut`` the small intermediates that several facts read (signatures, identity days,
    identities) are written once and read back. With ``reported`` (the source's own totals by run and
    schema) the pass over the rows is observed, and ``prefetch`` refuses an incomplete one.
    """

    def __init__(
        self,
        alerts: DataFrame,
        reg: Registry,
        runs: DataFrame,
        span: tuple[datetime, datetime],
        cut: bool = False,
        reported: DataFrame | None = None,
    ) -> None:
        self.alerts, self.reg, self.runs, self.span, self.cut = alerts, reg, runs, span, cut
        self.reported = reported

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.cut else df

    def prefetch(self) -> Analysis:
        """Two passes over the events: one judges all rows, one fetches those that are shown. What
        follows from either runs side by side."""
        self.rows  # noqa: B018 - shared input, written once
        if self.observed is not None:
            self.observed.check()
        together(lambda: self.signatures, lambda: self.shown, lambda: self.episodes, lambda: self.scope_days)
        return self

    @cached_property
    def observed(self) -> ObservedScan | None:
        # an observed pass keeps all columns that reach it
        rows = self.scoped.drop("raw", "doc_hash")
        return None if self.reported is None else ObservedScan(rows, self.reported)

    @cached_property
    def scoped(self) -> DataFrame:
        return scope_alerts(self.alerts, self.reg.team_operators, self.runs, self.span)

    @cached_property
    def leaves(self) -> DataFrame:
        return materialize(V.number_leaves(V.interpret_leaves(self.reg)), "leaves")

    @cached_property
    def panel_plans(self) -> DataFrame:
        return materialize(V.panel_plans(self.reg, self.leaves), "panel-plans")

    @cached_property
    def rows(self) -> DataFrame:
        scoped = self.scoped if self.observed is None else self.observed.rows
        return self._keep(R.narrow_rows(scoped, self.panel_plans), "rows")

    @cached_property
    def signatures(self) -> DataFrame:
        return self._keep(V.signatures_of(self.rows), "signatures")

    @cached_property
    def newest(self) -> DataFrame:
        return self._keep(R.newest(self.rows), "newest")

    @cached_property
    def first_findings(self) -> DataFrame:
        return self._keep(R.first_findings(self.rows), "first-findings")

    @cached_property
    def shown(self) -> DataFrame:
        return self._keep(R.shown_rows(self.scoped, self.newest, self.first_findings), "shown")

    @cached_property
    def evidence(self) -> DataFrame:
        return R.evidence_of(self.shown, self.first_findings)

    @cached_property
    def scope_days(self) -> DataFrame:
        return self._keep(D.counts_of_scopes(D.scopes_of(self.rows)), "scope-days")

    @cached_property
    def guarded(self) -> DataFrame:
        return V.guard_leaves(self.signatures, self.leaves, self.runs)

    @cached_property
    def active(self) -> DataFrame:
        return self._keep(V.active_panels(self.reg, self.guarded, self.runs), "active-panels")

    @cached_property
    def unmeasured(self) -> DataFrame:
        return V.unmeasured_counts(self.reg, self.guarded, self.runs)

    @cached_property
    def representatives(self) -> DataFrame:
        return self._keep(R.representatives_of(self.shown, self.newest), "representatives")

    @cached_property
    def episodes(self) -> DataFrame:
        return self._keep(E.firing_of_instants(E.instants_of(self.rows), keep=self._keep), "episodes")

    @cached_property
    def firing(self) -> DataFrame:
        return I.judged_firing(self.episodes, self.representatives)

    @cached_property
    def identity_days(self) -> DataFrame:
        resolved = V.resolve_visibility(self.signatures, self.active)
        return self._keep(I.identity_days(resolved, self.firing), "identity-days")

    @cached_property
    def identities(self) -> DataFrame:
        ids = I.identities(self.identity_days, self.representatives, self.firing)
        return self._keep(ids, "identities")


def representative_document() -> Column:
    """The stored document: the source text, or the typed fields where there is none."""
    shared = ["message", "severity", "operator", "key_field", "time_created", "node_name",
              "network", "alert_rule_url", "provider"]
    stamp = F.date_format("representative_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp")
    v1 = F.to_json(F.struct("application", c("component").alias("object"), *shared, stamp))
    v2 = F.to_json(
        F.struct("application", "component", *shared, "status", "impact", "runbook_url",
                 "environment", "site", stamp)
    )
    return F.coalesce("raw", F.when(c("alert_schema") == "v2", v2).otherwise(v1))


def eligible_alerts(a: Analysis) -> DataFrame:
    """Identities no core rule flagged, with what the classifier is shown."""
    return (
        a.identities.where(c("llm_eligible"))
        .withColumn("document", representative_document())
        .join(a.runs.select("run_id", "model_version"), "run_id")
        .withColumn("prompt_version", F.lit(K.PROMPT_VERSION))
        .select(
            *ID, "team_id", "alert_rule_url", "severity", "provider", "document", "doc_hash",
            "prompt_version", "model_version",
        )
    )


def quality_state() -> Column:
    return F.when(c("has_core_finding"), "rule_flagged").otherwise(
        F.coalesce("state", F.lit("unassessed"))
    )


def finding_rows(a: Analysis, outcomes: DataFrame) -> DataFrame:
    """``alert_findings``: one row per identity, exactly one quality state each."""
    entries = a.evidence.union(I.late_evidence(a.identities, a.active))
    joined = (
        a.identities.join(outcomes.drop("reused"), ID, "left")
        .join(I.evidence_documents(entries), ID, "left")
        .withColumn("quality_state", quality_state())
    )
    asked = c("quality_state") != "rule_flagged"
    return joined.select(
        *ID,
        "team_id",
        "representative_at",
        c("doc_hash").alias("representative_hash"),
        representative_document().alias("representative_doc"),
        "message",
        "severity",
        "component",
        "node_name",
        "environment",
        "provider",
        "alert_rule_url",
        "row_count",
        "first_seen",
        "last_seen",
        F.array_join("core_ids", ",").alias("core_rule_ids"),
        F.array_join("readiness_ids", ",").alias("readiness_rule_ids"),
        F.coalesce("findings_evidence", F.lit("[]")).alias("findings_evidence"),
        "quality_state",
        F.when(asked, c("principle_id")).alias("llm_principle_id"),
        F.when(asked, c("confidence")).alias("llm_confidence"),
        F.when(asked, c("justification")).alias("llm_justification"),
        F.when(
            c("quality_state") == "unassessed",
            F.coalesce("unassessed_reason", F.lit("identity was not assessed in this run")),
        ).alias("unassessed_reason"),
        "clear_count",
        "max_clear_cycles_24h",
        "fire_pattern",
        "unseen",
        "max_episode_firing_rows",
        F.timestamp_micros("open_us").alias("open_since"),
    )


def run_rows(a: Analysis, llm_assessed: bool) -> DataFrame:
    """``runs``: one row per run with its readiness and derived phase."""
    facts = I.run_readiness(a.identities).drop("team_id")
    joined = a.runs.join(facts, "run_id", "left").fillna(
        0, subset=["v1_identities", "v2_identities", "llm_eligible", "phase2_gap_identities"]
    )
    return joined.select(
        "run_id",
        "run_at",
        "team_id",
        "team_display_name",
        "window_start",
        "window_end",
        "registry_version",
        "registry_sha256",
        "registry_entry_snapshot",
        "ruleset_version",
        F.lit(K.PROMPT_VERSION).alias("prompt_version"),
        "model_version",
        F.lit(llm_assessed).alias("llm_assessed"),
        phase_of(c("v1_identities"), c("v2_identities"), c("phase2_readiness_pct")).alias(
            "phase_derived"
        ),
        "phase2_readiness_pct",
        F.lit(K.APP_VERSION).alias("app_version"),
        F.lit("completed").alias("status"),
        c("run_at").alias("completed_at"),
        "v1_identities",
        "v2_identities",
        "llm_eligible",
    )


def states_of(identities: DataFrame, outcomes: DataFrame) -> DataFrame:
    return (
        identities.join(outcomes.select(*ID, "state"), ID, "left")
        .withColumn("quality_state", quality_state())
        .withColumn("gap", I.has_gap())
        .select(*ID, "quality_state", "gap")
    )


def daily_metric_rows(a: Analysis, outcomes: DataFrame) -> DataFrame:
    volume = D.daily_volume(day_buckets(a.runs), a.scope_days, a.identity_days)
    return D.daily_metrics(
        volume, a.identity_days, states_of(a.identities, outcomes), a.unmeasured
    )


def rule_count_rows(a: Analysis) -> DataFrame:
    return D.daily_rule_counts(a.identity_days).join(
        a.runs.select("run_id", "ruleset_version"), "run_id"
    )


@dataclass(frozen=True)
class Facts:
    """The fact tables of one job."""

    runs: DataFrame
    daily_metrics: DataFrame
    daily_rule_counts: DataFrame
    alert_findings: DataFrame
    run_panels: DataFrame
    batches: DataFrame | None = None
    attempts: DataFrame | None = None
    new_verdicts: DataFrame | None = None
    outcomes: DataFrame | None = None
    members: DataFrame | None = None


def classify(
    a: Analysis, call: L.Call, verdicts: DataFrame | None = None
) -> tuple[DataFrame, ...]:
    """``(outcomes, batches, attempts, new verdicts, members)`` for the eligible identities.

    A verdict holds for its key in every later week of the job as well: a round asks about each key in
    the first week that is left of it, its answer goes to all later ones, and only what stays unanswered
    comes back in its next week. There are at most as many rounds as weeks.
    """
    ends = a.runs.select("run_id", "window_end")
    eligible = materialize(eligible_alerts(a).join(ends, "run_id"), "eligible")
    if verdicts is None:
        none = F.lit("")
        stored = eligible.limit(0).select(
            "application", "key_field", "prompt_version", "model_version",
            none.alias("assessment"), none.alias("principle_id"), none.alias("confidence"),
            none.alias("justification"),
        )
    else:
        stored = verdicts
    reused, remaining = L.reuse_verdicts(eligible, stored)
    remaining = materialize(remaining, "remaining")
    rounds: list[tuple[DataFrame, ...]] = []
    while not rounds or not remaining.isEmpty():
        placed = materialize(L.batch_members(L.first_weeks(remaining)), "members")
        table = materialize(L.batches(placed), "batches")
        members = materialize(L.with_batch_id(placed, table), "batch-members")
        request_table = materialize(L.requests(members, table), "requests")
        answers, attempts, failed = L.assess(request_table, members, call)
        answered = materialize(L.key_verdicts(answers, members), "key-verdicts")
        left = remaining.join(placed.select(*ID), ID, "left_anti")
        again = left.join(answered, L.VERDICT_KEY)
        again = again if rounds else again.unionByName(reused, allowMissingColumns=True)
        outcomes = materialize(L.outcomes_of(answers, again, failed, members), "outcomes")
        fresh = answers.join(
            members.select(*L.BATCH, "alert_id", "document", "doc_hash", "prompt_version", "model_version"),
            [*L.BATCH, "alert_id"],
        ).select(
            "application", "key_field", "prompt_version", "model_version", "alert_schema",
            "assessment", "principle_id", "confidence", "justification",
            c("document").alias("representative_doc"), "doc_hash",
            F.lit(K.RULESET_VERSION).alias("ruleset_version"), c("run_id").alias("first_run_id"),
        )
        rounds.append((outcomes, request_table, attempts, fresh, members))
        remaining = materialize(left.join(answered, L.VERDICT_KEY, "left_anti"), "remaining")
    return tuple(reduce(DataFrame.unionByName, parts) for parts in zip(*rounds, strict=True))


def compute_facts(
    alerts: DataFrame,
    reg: Registry,
    runs: DataFrame,
    span: tuple[datetime, datetime],
    call: L.Call | None = None,
    verdicts: DataFrame | None = None,
    disabled_reason: str = "LLM assessment did not run",
    reported: DataFrame | None = None,
) -> Facts:
    """Run the whole job. Without ``call`` every eligible identity is unassessed, with a reason.

    With the source's ``reported`` totals an incomplete scan is an ``IncompleteScan`` before any fact."""
    a = Analysis(alerts, reg, runs, span, cut=True, reported=reported).prefetch()
    return facts_of(a, call, verdicts, disabled_reason)


def facts_of(
    a: Analysis,
    call: L.Call | None = None,
    verdicts: DataFrame | None = None,
    disabled_reason: str = "LLM assessment did not run",
) -> Facts:
    """The fact tables of an analysis, of a batch or of a stream."""
    batches = attempts = fresh = members = None
    if call is None:
        outcomes = L.mark_unassessed(a.identities.where(c("llm_eligible")), disabled_reason)
    else:
        outcomes, batches, attempts, fresh, members = classify(a, call, verdicts)
    return Facts(
        runs=run_rows(a, call is not None),
        daily_metrics=daily_metric_rows(a, outcomes),
        daily_rule_counts=rule_count_rows(a),
        alert_findings=finding_rows(a, outcomes),
        run_panels=V.panel_participation(a.reg, a.guarded, a.runs),
        batches=batches,
        attempts=attempts,
        new_verdicts=fresh,
        outcomes=outcomes,
        members=members,
    )
