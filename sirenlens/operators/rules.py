"""Deterministic row rules: one boolean column and one evidence column per rule.

All rules of a row are evaluated in one projection. Evidence is JSON text and is only built
for rows that match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.instants import iso_instant, parse_instant
from sirenlens.functions.scalars import is_http_url
from sirenlens.functions.text import (
    field_in,
    is_blank,
    message_in,
    normalize_field,
    normalize_message,
    strip,
)

# rules a single row decides, with their bit in a row's rule mask
ROW_RULES = ("R1", "R2", "R3", "R4", "R7", "R8", "R9", "R10")
BIT = {rule: 1 << i for i, rule in enumerate(ROW_RULES)}
CORE_MASK = sum(BIT[r] for r in ("R1", "R2", "R3", "R4", "R7"))
READINESS_MASK = sum(BIT[r] for r in K.READINESS_RULES)

c = F.col


def _v2() -> Column:
    return c("alert_schema") == "v2"


def r1() -> Column:
    return message_in(c("message"), K.GENERIC_MESSAGES)


def r2() -> Column:
    return message_in(c("message"), K.HEARTBEAT_MESSAGES)


def _metadata_fields() -> list[tuple[Column, Column, bool]]:
    component = F.when(_v2(), "component").otherwise("object")
    return [
        (F.lit("application"), c("application"), True),
        (F.lit("operator"), c("operator"), True),
        (component, c("component"), True),
        (F.lit("node_name"), c("node_name"), False),
    ]


def r3() -> Column:
    hits = []
    for _, value, required in _metadata_fields():
        bad = field_in(value, K.PLACEHOLDERS)
        hits.append(is_blank(value) | bad if required else bad)
    return hits[0] | hits[1] | hits[2] | hits[3]


def r3_violations() -> Column:
    """Every violating field of the row, in field order, as an array of structs."""
    entries = []
    for name, value, required in _metadata_fields():
        normalized = normalize_field(value)
        reason = F.when(is_blank(value), F.lit("empty") if required else F.lit(None)).when(
            field_in(value, K.PLACEHOLDERS), "placeholder"
        )
        entries.append(
            F.struct(
                name.alias("field"),
                reason.alias("reason"),
                F.when(reason == "placeholder", normalized).alias("normalized"),
            )
        )
    return F.filter(F.array(*entries), lambda v: v["reason"].isNotNull())


def r4() -> Column:
    grafana = field_in(c("provider"), ("grafana",))
    return grafana & is_blank(c("alert_rule_url"))


def created_us() -> Column:
    """The parsed creation time of a v1 row."""
    v1 = c("alert_schema") == "v1"
    return F.when(v1, F.unix_micros(parse_instant(strip(c("time_created")))))


def r7_reason(created: Column) -> Column:
    """Why a v1 creation time is invalid, or NULL: it must lie in [receipt - 24h, receipt]."""
    receipt = F.unix_micros("ts")
    reason = (
        F.when(is_blank(c("time_created")), "missing")
        .when(created.isNull(), "unparseable")
        .when(created > receipt, "future")
        .when(created < receipt - K.DAY_US, "older_than_24h")
    )
    return F.when(c("alert_schema") == "v1", reason)


def _text_gap(value: str, kind: str) -> Column:
    """Why a text field is unusable: missing, not a string, empty or a placeholder."""
    return (
        F.when(c(kind).isNull() | (c(kind) == "missing"), "missing")
        .when(c(kind) != "str", "not_a_string")
        .when(is_blank(c(value)), "empty")
        .when(field_in(c(value), K.PLACEHOLDERS), "placeholder")
    )


def r8_reason() -> Column:
    return F.when(_v2(), _text_gap("impact", "impact_kind"))


def is_critical() -> Column:
    return field_in(c("severity"), ("critical",))


def r9_reason() -> Column:
    gap = F.coalesce(
        _text_gap("runbook_url", "runbook_kind"),
        F.when(~is_http_url(strip(c("runbook_url"))), "not_absolute_http"),
    )
    return F.when(_v2(), gap)


def r10() -> Column:
    return _v2() & message_in(c("impact"), K.TECHNICAL_IMPACTS)


def matches(created: Column) -> dict[str, Column]:
    return {
        "R1": r1(),
        "R2": r2(),
        "R3": r3(),
        "R4": r4(),
        "R7": r7_reason(created).isNotNull(),
        "R8": r8_reason().isNotNull(),
        "R9": r9_reason().isNotNull(),
        "R10": r10(),
    }


def with_rule_mask(rows: DataFrame) -> DataFrame:
    """All row rules of a row as one small integer ``rule_mask``: the whole dispatch, in one
    pass. The creation time is parsed once, in its own projection."""
    staged = rows.withColumn("created_us", created_us())
    mask = F.lit(0)
    for rule, hit in matches(c("created_us")).items():
        mask = mask + F.when(hit, BIT[rule]).otherwise(0)
    return staged.withColumn("rule_mask", mask)


def has_rule(mask: Column, rule: str) -> Column:
    return mask.bitwiseAND(BIT[rule]) != 0


def mask_ids(mask: Column, rules: tuple[str, ...]) -> Column:
    """The rule ids set in a mask, in rule order."""
    ids = F.array(*[F.when(has_rule(mask, r), F.lit(r)) for r in rules])
    return F.array_compact(ids)


def _json(**fields: Column) -> Column:
    named = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.to_json(named, {"ignoreNullFields": "false"})


def evidence(rule: Column, created: Column) -> Column:
    """What matched, as JSON text, for a row that matches ``rule``."""
    r7 = r7_reason(created)
    late = r7.isin("future", "older_than_24h")
    receipt = _json(reason=r7, time_created=c("time_created"), timestamp=iso_instant(c("ts")))
    plain7 = _json(reason=r7, time_created=c("time_created"))
    r8, r9 = r8_reason(), r9_reason()
    base = {"severity": c("severity"), "blocks_completion": is_critical()}
    typed9 = _json(**base, reason=r9, type=c("runbook_kind"))
    named9 = _json(**base, reason=r9, normalized=normalize_field(c("runbook_url")))
    typed8 = _json(reason=r8, type=c("impact_kind"))
    named8 = _json(reason=r8, normalized=normalize_field(c("impact")))
    return (
        F.when(
            rule.isin("R1", "R2"),
            _json(field=F.lit("message"), normalized=normalize_message(c("message"))),
        )
        .when(rule == "R3", F.to_json(F.struct(r3_violations().alias("violations"))))
        .when(rule == "R4", _json(provider=c("provider"), alert_rule_url=c("alert_rule_url")))
        .when((rule == "R7") & late, receipt)
        .when(rule == "R7", plain7)
        .when((rule == "R8") & (r8 == "not_a_string"), typed8)
        .when((rule == "R8") & (r8 == "placeholder"), named8)
        .when(rule == "R8", _json(reason=r8))
        .when((rule == "R9") & (r9 == "not_a_string"), typed9)
        .when((rule == "R9") & (r9 == "placeholder"), named9)
        .when(rule == "R9", _json(**base, reason=r9))
        .otherwise(_json(field=F.lit("impact"), normalized=normalize_message(c("impact"))))
    )


def row_findings(rows: DataFrame) -> DataFrame:
    """One output row per (alert row, matching rule) with its evidence. Rows without a finding
    leave before the explode, and evidence is built after it."""
    marked = with_rule_mask(rows).where(c("rule_mask") != 0)
    found = marked.withColumn("rule_id", F.explode(mask_ids(c("rule_mask"), ROW_RULES)))
    return found.withColumn(
        "rule_set", F.when(c("rule_id").isin(*K.CORE_RULES), "core").otherwise("v2_readiness")
    ).withColumn("evidence", evidence(c("rule_id"), c("created_us")))


def completion_ready(mask: Column, severity: Column) -> Column:
    """A v2 representative is ready: no R8, no R10, and no R9 when it is critical."""
    blocking = field_in(severity, ("critical",)) & has_rule(mask, "R9")
    return ~has_rule(mask, "R8") & ~has_rule(mask, "R10") & ~blocking


def phase_of(v1: Column, v2: Column, readiness_pct: Column) -> Column:
    return (
        F.when((v1 == 0) & (v2 == 0), "no_data")
        .when(v2 == 0, "phase_0")
        .when(v1 > 0, "phase_1")
        .when(F.coalesce(readiness_pct >= 100, F.lit(False)), "done")
        .otherwise("phase_2")
    )
