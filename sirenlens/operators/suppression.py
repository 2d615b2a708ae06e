"""What a team's own dashboard panels hide.

Panel predicates arrive as a table. They are interpreted once (configuration-sized), packed to
one row per team and schema, and joined to the alert rows. The blast-radius guard needs the
whole window's denominator, so rows are first collapsed to signatures and the guard is applied
to those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.operators.attach import attach
from sirenlens.operators.rules import CORE_MASK, with_rule_mask
from sirenlens.sources.registry import Registry
from sirenlens.sources.schema import IDENTITY

c = F.col
LEAF = ("team_id", "panel_id", "alert_schema", "leaf_no")
# --- fixed values: reasons written for leaves that are not evaluated
NESTED = "suppression leaf is nested inside OR/NOT and cannot be evaluated safely"
NESTED_IDENTITY = "identity leaf is nested inside OR/NOT and cannot be evaluated safely"
ALL_SELECTED = "multi-value variable with all selected"
NO_VALUES = "negation resolved to no values"
NO_IDENTITY_VALUES = "identity leaf resolved to no values or has no alert attribute"
NO_ATTRIBUTE = "instance field has no corresponding alert attribute"


def field_class(field: Column) -> Column:
    name = F.lower(field)
    return (
        F.when(name.isin(*K.INSTANCE_FIELDS), "instance")
        .when(name.isin(*K.CLASSIFICATION_FIELDS), "classification")
        .otherwise("unknown")
    )


def is_identity_field(field: Column) -> Column:
    return F.coalesce(F.lower(field).isin(*K.IDENTITY_FIELDS), F.lit(False))


def _attribute(field: Column, known: tuple[str, ...]) -> Column:
    name = F.lower(field)
    column = F.when(name == "object", "component").otherwise(name)
    return F.when(name.isin(*known), column)


def record_attribute(field: Column) -> Column:
    return _attribute(field, K.INSTANCE_FIELDS)


def identity_attribute(field: Column) -> Column:
    return _attribute(field, K.IDENTITY_FIELDS)


def resolve_operands(reg: Registry) -> DataFrame:
    """Every operand of every predicate with the values it stands for, or why it has none."""
    operands = reg.panel_predicates.select(
        *LEAF, F.posexplode_outer("operands").alias("pos", "operand")
    ).select(*LEAF, "pos", "operand.*")
    variables = reg.panel_variables.select(
        "team_id",
        "panel_id",
        "alert_schema",
        c("name").alias("value"),
        F.lit("variable").alias("kind"),
        c("type").alias("var_type"),
        c("value").alias("var_value"),
        c("values").alias("var_values"),
        F.coalesce("all_selected", F.lit(False)).alias("var_all"),
    )
    joined = operands.join(
        variables, ["team_id", "panel_id", "alert_schema", "kind", "value"], "left"
    )
    single = c("var_type").isin("constant", "interval")
    values = (
        F.when(c("kind") == "literal", F.array("value"))
        .when(single & c("var_value").isNotNull(), F.array("var_value"))
        .when(c("var_type") == "custom", c("var_values"))
    )
    q = F.lit('"')
    name = F.concat(F.lit("variable "), q, c("value"), q)
    reason = (
        F.when(c("kind") == "literal", F.lit(None).cast("string"))
        .when(c("kind") == "field", F.lit("comparison against another column is not interpreted"))
        .when(
            c("kind") != "variable",
            F.concat(F.lit('operand of kind "'), c("kind"), F.lit('" is not interpreted')),
        )
        .when(c("var_type").isNull(), F.concat(F.lit("no frozen definition supplied for "), name))
        .when(
            c("var_type") == "query",
            F.concat(name, F.lit(" is a query variable and is never executed")),
        )
        .when(
            single & c("var_value").isNull(),
            F.concat(name, F.lit(" is "), c("var_type"), F.lit(" but supplies no value")),
        )
        .when(
            ~single & c("var_values").isNull(),
            F.concat(name, F.lit(" is custom but supplies no values")),
        )
    )
    known = joined.where(c("kind").isNotNull())
    return known.select(
        *LEAF,
        "pos",
        "kind",
        "value",
        values.alias("resolved_values"),
        F.coalesce(c("var_all") & (c("var_type") == "custom"), F.lit(False)).alias("all_selected"),
        reason.alias("reason"),
    )


def interpret_leaves(reg: Registry) -> DataFrame:
    """The meaning of every leaf: suppression, identity, unmeasured, identity_unmeasured or
    ignored, with the values it compares and the reason when it is not used."""
    problem = c("reason").isNotNull()
    per_leaf = (
        resolve_operands(reg)
        .groupBy(*LEAF)
        .agg(
            F.flatten(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.struct(
                                "pos",
                                F.coalesce(
                                    "resolved_values", F.array().cast("array<string>")
                                ).alias("v"),
                            )
                        )
                    ),
                    lambda s: s["v"],
                )
            ).alias("leaf_values"),
            F.min_by("reason", F.when(problem, c("pos"))).alias("first_reason"),
            F.min(F.when(problem, c("pos"))).alias("first_problem"),
            F.min(F.when(c("all_selected"), c("pos"))).alias("first_all"),
        )
    )
    leaves = reg.panel_predicates.join(per_leaf, list(LEAF), "left").withColumn(
        "leaf_values", F.coalesce("leaf_values", F.array().cast("array<string>"))
    )
    negated, nested = F.coalesce("negated", F.lit(False)), F.coalesce("nested", F.lit(False))
    positive = (
        F.when((c("kind") == "comparison") & (c("op") == "="), "=")
        .when((c("kind") == "in") & ~negated, "IN")
        .when((c("kind") == "like") & ~negated, "LIKE")
    )
    negation = (
        F.when((c("kind") == "comparison") & c("op").isin("!=", "<>"), c("op"))
        .when((c("kind") == "in") & negated, "NOT IN")
        .when((c("kind") == "like") & negated, "NOT LIKE")
    )
    klass, empty = field_class(c("field")), F.size("leaf_values") == 0
    narrowing = is_identity_field(c("field")) & positive.isNotNull()
    all_first = c("first_all").isNotNull() & (
        c("first_problem").isNull() | (c("first_all") < c("first_problem"))
    )
    call_text = F.when(
        F.coalesce("macro", F.lit(False)) & c("op").isin(*K.MECHANICAL_MACROS),
        F.concat(F.lit("mechanical macro $"), c("op")),
    ).otherwise(F.concat(F.lit("function call "), c("op"), F.lit("() is not interpreted")))

    steps: list[tuple[Column, str, Column | str]] = [
        (c("kind") == "call", "ignored", call_text),
        (c("field").isNull(), "ignored", "predicate does not compare a plain column"),
        (narrowing & nested, "identity_unmeasured", NESTED_IDENTITY),
        (narrowing & all_first, "ignored", ALL_SELECTED),
        (narrowing & c("first_problem").isNotNull(), "identity_unmeasured", c("first_reason")),
        (
            narrowing & (empty | identity_attribute(c("field")).isNull()),
            "identity_unmeasured",
            NO_IDENTITY_VALUES,
        ),
        (narrowing, "identity", F.lit(None).cast("string")),
        (klass == "classification", "ignored", "classification dimension"),
        (klass == "unknown", "ignored", "unknown field, ignored and logged"),
        (negation.isNull(), "ignored", "instance field, but not a negation"),
        (nested, "unmeasured", NESTED),
        (c("first_problem").isNotNull(), "unmeasured", c("first_reason")),
        (empty, "unmeasured", NO_VALUES),
        (record_attribute(c("field")).isNull(), "unmeasured", NO_ATTRIBUTE),
    ]
    outcome: Column | None = None
    reason: Column | None = None
    for condition, kind, why in steps:
        why = why if isinstance(why, Column) else F.lit(why)
        outcome = F.when(condition, kind) if outcome is None else outcome.when(condition, kind)
        reason = F.when(condition, why) if reason is None else reason.when(condition, why)
    assert outcome is not None and reason is not None
    kind = outcome.otherwise("suppression")
    used = kind.isin("suppression", "identity")
    return leaves.select(
        *LEAF,
        "field",
        F.coalesce(positive, negation).alias("operator"),
        kind.alias("outcome"),
        reason.alias("reason"),
        F.when(used, c("leaf_values")).alias("leaf_values"),
        F.when(kind == "identity", identity_attribute(c("field")))
        .when(kind == "suppression", record_attribute(c("field")))
        .alias("attribute"),
        (~c("kind").isin("call") & (klass == "unknown") & c("field").isNotNull()).alias(
            "unknown_field"
        ),
    )


def like_regex(pattern: Column) -> Column:
    """An anchored, case-sensitive regex for a LIKE pattern: ``%`` and ``_`` span newlines and
    nothing escapes them."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1")
    body = F.replace(F.replace(quoted, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit("."))
    return F.concat(F.lit("(?sd)^"), body, F.lit("$"))


def _like_plan(pattern: Column) -> Column:
    """How to test one LIKE pattern. The common shapes need no regex per row."""
    inner = F.regexp_replace(pattern, r"\A%|%\z", "")
    plain = ~inner.rlike("[%_]")
    starts, ends = pattern.startswith("%"), pattern.endswith("%")
    how = (
        F.when(~plain, "regex")
        .when(starts & ends, "contains")
        .when(ends, "prefix")
        .when(starts, "suffix")
        .otherwise("exact")
    )
    text = F.when(how == "regex", like_regex(pattern)).otherwise(inner)
    return F.struct(how.alias("how"), text.alias("text"))


def _like_hit(value: Column, plan: Column) -> Column:
    text = plan["text"]
    # a final newline does not defeat the end anchor
    newline = F.concat(text, F.lit("\n"))
    return (
        F.when(plan["how"] == "exact", (value == text) | (value == newline))
        .when(plan["how"] == "prefix", value.startswith(text))
        .when(plan["how"] == "suffix", value.endswith(text) | value.endswith(newline))
        .when(plan["how"] == "contains", F.contains(value, text))
        .otherwise(F.rlike(value, text))
    )


def like_matches(value: Column, pattern: Column) -> Column:
    """Does a value match a LIKE pattern?"""
    return _like_hit(value, _like_plan(pattern))


def number_leaves(leaves: DataFrame) -> DataFrame:
    """Number a team-schema's leaves 0..n-1; the window is over configuration rows."""
    order = Window.partitionBy("team_id", "alert_schema").orderBy("panel_id", "leaf_no")
    return leaves.withColumn("leaf_id", F.row_number().over(order) - 1)


def panel_plans(reg: Registry, leaves: DataFrame) -> DataFrame:
    """One row per team and schema with panels: its evaluable leaves and its panels."""
    is_like = c("operator").isin("LIKE", "NOT LIKE")
    leaf = F.struct(
        "leaf_id",
        "panel_id",
        "attribute",
        is_like.alias("is_like"),
        F.when(~is_like, c("leaf_values")).alias("eq"),
        F.when(is_like, F.transform("leaf_values", _like_plan)).alias("likes"),
    )
    usable = leaves.where(c("outcome").isin("suppression", "identity"))
    packed = usable.groupBy("team_id", "alert_schema").agg(
        F.array_sort(F.collect_list(F.when(c("outcome") == "suppression", leaf))).alias(
            "suppression_leaves"
        ),
        F.array_sort(F.collect_list(F.when(c("outcome") == "identity", leaf))).alias(
            "identity_leaves"
        ),
    )
    panels = reg.panels.groupBy("team_id", "alert_schema").agg(
        F.array_sort(F.collect_list("panel_id")).alias("panel_ids")
    )
    return panels.join(packed, ["team_id", "alert_schema"], "left")


def _row_value(attribute: Column) -> Column:
    value = F.lit(None).cast("string")
    for name in ("node_name", "message", "component", "key_field", "alert_rule_url", "application", "operator"):
        value = F.when(attribute == name, c(name)).otherwise(value)
    return value


def _leaf_matches(leaf: Column) -> Column:
    value = _row_value(leaf["attribute"])
    hit = F.when(
        leaf["is_like"], F.exists(leaf["likes"], lambda p: _like_hit(value, p))
    ).otherwise(F.array_contains(leaf["eq"], value))
    return F.coalesce(hit, F.lit(False))


def _leaf_hides(leaf: Column) -> Column:
    return _row_value(leaf["attribute"]).isNotNull() & ~_leaf_matches(leaf)


def mark_visibility(scoped: DataFrame, plans: DataFrame) -> DataFrame:
    """Per row: which suppression leaves exclude it and whether every panel's identity
    narrowing hides it. NULL never matches and never hides."""
    joined = attach(scoped, plans, ["team_id", "alert_schema"], ["application", "key_field", "ts"])
    hits = F.transform(
        F.filter("suppression_leaves", _leaf_matches), lambda leaf: leaf["leaf_id"]
    )
    hiding = F.transform(F.filter("identity_leaves", _leaf_hides), lambda leaf: leaf["panel_id"])
    hidden = F.coalesce(
        (F.size("panel_ids") > 0)
        & F.forall("panel_ids", lambda p: F.array_contains(c("hiding_panels"), p)),
        F.lit(False),
    )
    return (
        joined.withColumn("hit_leaves", F.coalesce(hits, F.array().cast("array<int>")))
        .withColumn("hiding_panels", F.coalesce(hiding, F.array().cast("array<string>")))
        .withColumn("hidden", hidden)
        .drop("suppression_leaves", "identity_leaves", "panel_ids", "hiding_panels")
    )


def signatures(scoped: DataFrame, plans: DataFrame) -> DataFrame:
    """Collapse rows to (identity, day, rule mask, matched leaves, hidden) with a count.

    Everything the rule counts, the guard and the visibility figures need survives; event
    volume does not. Partial aggregation collapses a hot identity before the shuffle.
    """
    return signatures_of(mark_visibility(with_rule_mask(scoped), plans))


def signatures_of(marked: DataFrame) -> DataFrame:
    """The signatures of rows that are judged already."""
    return marked.groupBy(
        "team_id", *IDENTITY, "snapshot_date", "rule_mask", "hit_leaves", "hidden"
    ).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def guard_leaves(sigs: DataFrame, leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Every leaf of every run after the blast-radius guard: a suppression leaf matching more
    than half of the run's rows of that schema becomes unmeasured (exactly half still applies).
    """
    totals = sigs.groupBy("run_id", "alert_schema").agg(F.sum("n").alias("total_rows"))
    matched = (
        sigs.where(F.size("hit_leaves") > 0)
        .select("run_id", "alert_schema", "n", F.explode("hit_leaves").alias("leaf_id"))
        .groupBy("run_id", "alert_schema", "leaf_id")
        .agg(F.sum("n").alias("matched"))
    )
    per_run = runs.select("run_id", "team_id").join(leaves, "team_id")
    joined = (
        per_run.join(totals, ["run_id", "alert_schema"], "left")
        .join(matched, ["run_id", "alert_schema", "leaf_id"], "left")
        .withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))
        .withColumn(
            "matched_rows",
            F.when(c("outcome") == "suppression", F.coalesce("matched", F.lit(0))),
        )
    )
    wide = (c("outcome") == "suppression") & (2 * c("matched_rows") > c("total_rows"))
    text = F.concat(
        F.lit("blast radius "),
        c("matched_rows").cast("string"),
        F.lit("/"),
        c("total_rows").cast("string"),
        F.lit(" exceeds 50% of owned rows; routed to human review"),
    )
    return joined.select(
        "run_id",
        *LEAF,
        "leaf_id",
        "field",
        "operator",
        F.when(wide, "unmeasured").otherwise(c("outcome")).alias("outcome"),
        F.when(wide, text).otherwise(c("reason")).alias("reason"),
        "leaf_values",
        "matched_rows",
        "total_rows",
        "unknown_field",
    )


def active_panels(reg: Registry, guarded: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and schema with panels: each panel's active leaves. A panel without one (also an
    unparseable panel) keeps its empty entry, so nothing can be unanimous over it."""
    active = (
        guarded.where(c("outcome") == "suppression")
        .groupBy("run_id", "team_id", "panel_id", "alert_schema")
        .agg(F.collect_list("leaf_id").alias("active"))
    )
    return (
        runs.select("run_id", "team_id")
        .join(reg.panels, "team_id")
        .join(active, ["run_id", "team_id", "panel_id", "alert_schema"], "left")
        .groupBy("run_id", "alert_schema")
        .agg(
            F.collect_list(F.coalesce("active", F.array().cast("array<int>"))).alias("panels"),
            F.array_sort(F.collect_list("panel_id")).alias("panel_ids"),
        )
    )


def resolve_visibility(sigs: DataFrame, active: DataFrame) -> DataFrame:
    """Signatures with ``suppressed`` (excluded by every panel) and ``unseen`` (hidden by every
    panel and not suppressed). ``has_panel`` keeps *not measured* apart from zero."""
    spread = ["application", "key_field", "snapshot_date", "rule_mask"]
    joined = attach(sigs, active, ["run_id", "alert_schema"], spread)
    every = F.forall("panels", lambda p: F.arrays_overlap(p, c("hit_leaves")))
    suppressed = F.coalesce((F.size("panels") > 0) & every, F.lit(False))
    return (
        joined.withColumn("has_panel", c("panels").isNotNull())
        .withColumn("suppressed", suppressed)
        .withColumn("unseen", c("hidden") & ~c("suppressed"))
        .withColumn("core_row", c("rule_mask").bitwiseAND(CORE_MASK) != 0)
    )


def unmeasured_counts(reg: Registry, guarded: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run and schema with panels: clauses that could not be measured. An unparseable panel
    adds one to both counters."""
    leaf_counts = guarded.groupBy("run_id", "alert_schema").agg(
        F.count_if(c("outcome") == "unmeasured").alias("u"),
        F.count_if(c("outcome") == "identity_unmeasured").alias("iu"),
    )
    broken = (
        runs.select("run_id", "team_id")
        .join(reg.panels, "team_id")
        .groupBy("run_id", "alert_schema")
        .agg(F.count_if(c("parse_state") == "unparseable").alias("broken"))
    )
    zero = F.lit(0)
    return broken.join(leaf_counts, ["run_id", "alert_schema"], "left").select(
        "run_id",
        "alert_schema",
        (c("broken") + F.coalesce("u", zero)).alias("suppression_unmeasured"),
        (c("broken") + F.coalesce("iu", zero)).alias("unseen_unmeasured"),
    )


def visibility_notes(reg: Registry, guarded: DataFrame, runs: DataFrame) -> DataFrame:
    """Why something could not be measured, one row per panel or leaf."""
    broken = (
        runs.select("run_id", "team_id")
        .join(reg.panels.where(c("parse_state") == "unparseable"), "team_id")
        .select("run_id", "alert_schema", "panel_id", c("parse_error").alias("note"))
    )
    leaf_notes = guarded.where(c("outcome").isin("unmeasured", "identity_unmeasured")).select(
        "run_id",
        "alert_schema",
        "panel_id",
        F.concat(c("field"), F.lit(" - "), c("reason")).alias("note"),
    )
    return broken.union(leaf_notes)


def panel_participation(reg: Registry, guarded: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_panels``: per run and panel, how many leaves suppressed or could not be measured."""
    counts = guarded.groupBy("run_id", "team_id", "panel_id", "alert_schema").agg(
        F.count_if(c("outcome") == "suppression").alias("s"),
        F.count_if(c("outcome") == "unmeasured").alias("u"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(c("unknown_field"), c("field")))), ","
        ).alias("unknown_fields"),
    )
    zero = F.lit(0)
    return (
        runs.select("run_id", "team_id")
        .join(reg.panels, "team_id")
        .join(counts, ["run_id", "team_id", "panel_id", "alert_schema"], "left")
        .select(
            "run_id",
            "panel_id",
            "alert_schema",
            F.sha2(F.coalesce("sql", F.lit("")), 256).alias("sql_text_hash"),
            F.lit(K.PARSER_VERSION).alias("parser_version"),
            F.coalesce("s", zero).alias("suppression_leaves"),
            F.when(c("parse_state") == "unparseable", 1)
            .otherwise(F.coalesce("u", zero))
            .alias("unmeasured_leaves"),
            F.coalesce("unknown_fields", F.lit("")).alias("unknown_fields"),
            c("parse_state").alias("safety_state"),
            c("parse_error").alias("unmeasured_reason"),
        )
    )
