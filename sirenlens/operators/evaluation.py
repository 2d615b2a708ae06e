"""Measuring the classifier against annotated cases. Descriptive rates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.scalars import ratio
from sirenlens.functions.text import id_list, strip
from sirenlens.operators.ordered import with_running
from sirenlens.session import materialize

c = F.col


def group_key() -> Column:
    url = F.coalesce("alert_rule_url", F.lit(""))
    return F.when(url != "", F.concat(F.lit("url:"), url)).otherwise(
        F.concat(F.lit("app:"), c("application"))
    )


def score(cases: DataFrame) -> DataFrame:
    """Per case: was the citation and confidence right, was it a high finding, was it missed.

    ``cases`` carries the outcome (``state, principle_id, confidence``) next to the annotation
    (``expected_principles, expected_confidences`` as comma-joined lists).
    """
    wanted, sure = id_list(c("expected_principles")), id_list(c("expected_confidences"))
    violating = c("expected_principles") != "NONE"
    false = F.lit(False)
    return (
        cases.withColumn("expected_violation", violating)
        .withColumn(
            "citation_correct", F.coalesce(F.array_contains(wanted, c("principle_id")), false)
        )
        .withColumn(
            "confidence_correct", F.coalesce(F.array_contains(sure, c("confidence")), false)
        )
        .withColumn("high_catalogue", c("state") == "llm_flagged")
        .withColumn("missed_as_good", violating & (c("state") == "assessed_good"))
        .withColumn("group_key", group_key())
    )


def _rates() -> list[Column]:
    high = F.count_if(c("high_catalogue"))
    right_high = F.count_if(c("high_catalogue") & c("citation_correct"))
    known = F.count_if(c("expected_violation"))
    missed = F.count_if(c("missed_as_good"))
    n = F.count("*")
    return [
        n.alias("cases"),
        high.alias("high_findings"),
        ratio(right_high, high).alias("high_precision"),
        known.alias("known_violations"),
        missed.alias("missed_as_good"),
        ratio(missed, known).alias("missed_as_good_rate"),
        F.count_if(c("state") == "unassessed").alias("unassessed"),
        ratio(F.count_if(c("citation_correct")), n).alias("citation_accuracy"),
        ratio(F.count_if(c("confidence_correct")), n).alias("confidence_accuracy"),
    ]


def rates(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(*_rates())


def slice_rates(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The same rates by schema, provider, severity and expected principles: four single-column
    slices, one pass."""
    slices = F.array(
        *[
            F.concat(F.lit(f"{name}:"), F.coalesce(column, F.lit("None")))
            for name, column in (
                ("schema", c("alert_schema")),
                ("provider", c("provider")),
                ("severity", c("severity")),
                ("principle", F.replace(c("expected_principles"), F.lit(","), F.lit("|"))),
            )
        ]
    )
    return scored.withColumn("slice", F.explode(slices)).groupBy(*keys, "slice").agg(*_rates())


def group_weighted(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over rule/application groups, each group weighing the same."""
    per_group = scored.groupBy(*keys, "group_key").agg(*_rates())
    return per_group.groupBy(*keys).agg(
        F.count("*").alias("groups"),
        F.count("high_precision").alias("groups_with_high_findings"),
        F.avg("high_precision").alias("group_weighted_precision"),
        F.avg("citation_accuracy").alias("group_weighted_citation_accuracy"),
    )


def attempt_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Latency by nearest rank, and sums that are NULL when any part is unknown.

    Latencies are counted per value first, so a percentile never sorts all attempts in one
    place: the running count walks distinct milliseconds.
    """
    per_value = attempts.groupBy(*keys, "duration_ms").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("duration_ms")
    walked = per_value.withColumn(
        "upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    p50 = F.floor((c("total") - 1) / 2)
    p95 = F.least(c("total") - 1, F.floor(c("total") * F.lit(0.95)))
    latency = walked.groupBy(*keys).agg(
        F.min(F.when(c("upto") > p50, c("duration_ms"))).alias("latency_ms_p50"),
        F.min(F.when(c("upto") > p95, c("duration_ms"))).alias("latency_ms_p95"),
    )
    sums = attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.count_if(c("status") != "succeeded").alias("failed_attempts"),
        F.max("alert_count").alias("max_actual_batch"),
        F.when(F.count("tokens") == F.count("*"), F.sum("tokens")).alias("tokens"),
    )
    return sums.join(latency, keys)


def drawn_group(sample: Column, slot: Column, groups: Column) -> Column:
    """The group that a slot of a resample draws: a counter-based hash, so any task can draw any slot."""
    digest = F.md5(F.concat_ws("|", sample.cast("string"), slot.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % groups


def precision_interval(scored: DataFrame, keys: list[str], resamples: int = 1000) -> DataFrame:
    """``groups, low, high``: descriptive 95 % interval of the high-finding precision, by resampling
    whole groups with replacement.

    The groups of a key are numbered densely, whatever their number. A resample has as many slots as
    there are groups; each slot draws one, and only group totals meet the draws. Resamples without a
    high finding have no precision. NULL under two groups, or where no group has a high finding.
    """
    totals = scored.groupBy(*keys, "group_key").agg(
        F.count_if(c("high_catalogue")).alias("high"),
        F.count_if(c("high_catalogue") & c("citation_correct")).alias("right"),
    )
    numbered = materialize(with_running(totals, keys, [c("group_key")]), "bootstrap-groups")
    slots = numbered.where(c("group_size") > 1).select(
        *keys, "group_size", (c("rank") - 1).alias("slot"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("sample")
    )
    drawn = slots.select(*keys, "sample", (drawn_group(c("sample"), c("slot"), c("group_size")) + 1).alias("rank"))
    # how often a resample draws a group, then one join with the totals
    drawn = drawn.groupBy(*keys, "sample", "rank").agg(F.count("*").alias("times"))
    per_sample = (
        drawn.join(numbered.where("high > 0").select(*keys, "rank", "high", "right"), [*keys, "rank"])
        .groupBy(*keys, "sample")
        .agg(F.sum(c("times") * c("high")).alias("high"), F.sum(c("times") * c("right")).alias("right"))
        .select(*keys, (c("right") / c("high")).alias("precision"))
    )
    ranked = F.array_sort(F.collect_list("precision"))  # at most ``resamples`` values
    at = lambda q: F.element_at(
        c("p"), (F.floor((F.size("p") - 1) * F.lit(q)) + 1).cast("int")
    )
    interval = per_sample.groupBy(*keys).agg(ranked.alias("p"))
    interval = interval.select(*keys, at(0.025).alias("low"), at(0.975).alias("high"))
    counted = numbered.groupBy(*keys).agg(F.count("*").alias("groups"))
    return counted.join(interval, keys, "left")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paired trials by case: changed answers and new false high findings. A case on one side
    only is reported, because paired trials must assess the same cases."""
    keep = ["case_id", "state", "principle_id", "confidence", "high_catalogue", "citation_correct"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("case_id", *[c(n).alias(f"{tag}_{n}") for n in keep[1:]],
                         F.lit(True).alias(f"{tag}_present"))

    joined = side(before, "a").join(side(after, "b"), "case_id", "full_outer")
    differs = F.lit(False)
    for name in ("state", "principle_id", "confidence"):
        differs = differs | ~c(f"a_{name}").eqNullSafe(c(f"b_{name}"))
    bad_b = c("b_high_catalogue") & ~c("b_citation_correct")
    bad_a = c("a_high_catalogue") & ~c("a_citation_correct")
    paired = c("a_present").isNotNull() & c("b_present").isNotNull()
    return joined.select(
        "case_id",
        paired.alias("paired"),
        F.when(paired, differs).alias("changed"),
        F.when(paired, bad_b & ~bad_a).alias("new_false_high"),
    )


def corpus_problems(cases: DataFrame) -> DataFrame:
    """What makes an annotated corpus unusable: ``(problem, subject)`` rows."""
    principles, sure = id_list(c("expected_principles")), id_list(c("expected_confidences"))
    allowed = F.array(*[F.lit(x) for x in (*K.CITABLE, "NONE", "OTHER")])
    levels = F.array(*[F.lit(x) for x in K.CONFIDENCES])
    bad_label = (
        F.when(~c("alert_schema").isin("v1", "v2"), "schema")
        .when(~c("split").isin("development", "holdout"), "split")
        .when((F.size(principles) == 0) | (F.size(F.array_except(principles, allowed)) > 0), "principles")
        .when(F.array_contains(principles, "NONE") & (F.size(principles) > 1), "good and violating")
        .when((F.size(sure) == 0) | (F.size(F.array_except(sure, levels)) > 0), "confidences")
        .when(strip(F.coalesce("rationale", F.lit(""))) == "", "rationale")
    )
    labels = cases.withColumn("problem", bad_label).where(c("problem").isNotNull()).select(
        "problem", c("case_id").alias("subject")
    )

    def repeated(name: str, *keys: str) -> DataFrame:
        return cases.groupBy(*keys).agg(F.count("*").alias("n")).where(c("n") > 1).select(
            F.lit(name).alias("problem"), F.concat_ws("|", *keys).alias("subject")
        )

    def crossing(name: str, key: Column) -> DataFrame:
        spread = cases.select(key.alias("k"), "split").groupBy("k").agg(
            F.min("split").alias("lo"), F.max("split").alias("hi")
        )
        return spread.where(c("lo") != c("hi")).select(F.lit(name).alias("problem"), c("k").alias("subject"))

    return (
        labels.union(repeated("case id", "case_id"))
        .union(repeated("identity", "application", "key_field"))
        .union(crossing("family crosses splits", c("family")))
        .union(crossing("group crosses splits", group_key()))
    )
