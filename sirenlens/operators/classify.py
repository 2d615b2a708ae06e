"""Classifier work: what to send, in which batches, and what the answers mean.

The classifier itself is a function ``call(request_text, batch_id, attempt) -> response_text``
supplied by the caller. It runs inside tasks, on batches Spark has spread over the cluster;
everything before and after it is DataFrame work.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sirenlens.functions import catalogs as K
from sirenlens.functions.scalars import enc_int, enc_list, enc_text, stable_hash
from sirenlens.functions.text import field_in, is_blank
from sirenlens.operators.ordered import with_running
from sirenlens.session import materialize, shared_dir, together
from sirenlens.sources.schema import IDENTITY

c = F.col
ID = list(IDENTITY)
VERDICT_KEY = ["application", "key_field", "prompt_version", "model_version"]
GROUP = ["run_id", "group_type", "group_value"]
BATCH = ["run_id", "batch_id"]
#: Tasks that call the classifier side by side.
CONCURRENT_CALLS = 16
FIELDS = ("alert_id", "assessment", "principle_id", "confidence", "justification")


class ClassifierError(Exception):
    """A call that returned no usable text; ``kind`` is recorded as the attempt's status."""

    def __init__(self, message: str, kind: str = "transport_error") -> None:
        super().__init__(message)
        self.kind = kind


Call = Callable[[str, str, int], str]


def reuse_verdicts(eligible: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(reused, remaining)``: a stored verdict of the same prompt and model is never asked for
    again. Of several stored verdicts of one key the first in order of their values counts."""
    said = F.struct("assessment", "principle_id", "confidence", "justification")
    stored = verdicts.groupBy(*VERDICT_KEY).agg(F.min(said).alias("said")).select(*VERDICT_KEY, "said.*")
    reused = eligible.join(stored, VERDICT_KEY)
    return reused, eligible.join(stored, VERDICT_KEY, "left_anti")


def first_weeks(remaining: DataFrame) -> DataFrame:
    """The alerts to ask about now: of each verdict key those of its first week (then run) that is left."""
    turn = F.struct("window_end", "run_id")
    first = remaining.groupBy(*VERDICT_KEY).agg(F.min("window_end").alias("window_end"))
    runs = remaining.join(first, [*VERDICT_KEY, "window_end"]).groupBy(*VERDICT_KEY).agg(F.min(turn).alias("turn"))
    asking = runs.select(*VERDICT_KEY, "turn.run_id")
    return remaining.join(asking, [*VERDICT_KEY, "run_id"], "left_semi")


def key_verdicts(answers: DataFrame, members: DataFrame) -> DataFrame:
    """One verdict for each key that was answered; of several the first in order of their values."""
    said = ["assessment", "principle_id", "confidence", "justification"]
    keyed = answers.select(*BATCH, "alert_id", *said).join(members.select(*BATCH, "alert_id", *VERDICT_KEY), [*BATCH, "alert_id"])
    best = keyed.groupBy(*VERDICT_KEY).agg(F.min(F.struct(*said)).alias("said"))
    return best.select(*VERDICT_KEY, "said.*")


def transport_id() -> Column:
    return stable_hash(
        {
            "schema": enc_text(c("alert_schema")),
            "application": enc_text(c("application")),
            "key_field": enc_text(c("key_field")),
        }
    )


def with_group(alerts: DataFrame) -> DataFrame:
    """Group by rule URL where there is one, else by application; the two never mix."""
    by_url = ~is_blank(c("alert_rule_url"))
    return alerts.withColumn(
        "group_type", F.when(by_url, "alert_rule_url").otherwise("application")
    ).withColumn(
        "group_value", F.when(by_url, c("alert_rule_url")).otherwise(c("application"))
    )


def part_index(rank0: Column, size: Column, cap: int) -> Column:
    """Part of a 0-based rank when ``size`` splits into ceil(size/cap) parts that differ by at
    most one, larger parts first."""
    parts = F.ceil(size / F.lit(cap)).cast("long")
    base = F.floor(size / parts).cast("long")
    extra = size - base * parts
    head = extra * (base + 1)
    return (
        F.when(rank0 < head, F.floor(rank0 / (base + 1)))
        .otherwise(extra + F.floor((rank0 - head) / base))
        .cast("long")
    )


def batch_members(alerts: DataFrame, cap: int = K.MAX_BATCH) -> DataFrame:
    """Every alert with its batch: members ordered by (key_field, application)."""
    cap = min(cap, K.MAX_BATCH)
    ranked = with_running(
        with_group(alerts), GROUP, [c("key_field"), c("application"), c("alert_schema")]
    )
    rank0 = c("rank") - 1
    return (
        ranked.withColumn("partition_index", part_index(rank0, c("group_size"), cap))
        .withColumn("partition_count", F.ceil(c("group_size") / F.lit(cap)).cast("long"))
        .withColumn("alert_id", transport_id())
    )


def batch_hash(ids: Column) -> Column:
    return stable_hash(
        {
            "run_id": enc_text(c("run_id")),
            "group_type": enc_text(c("group_type")),
            "group_value": enc_text(c("group_value")),
            "partition_index": enc_int(c("partition_index")),
            "alert_ids": enc_list(ids),
            "prompt_version": enc_text(c("prompt_version")),
            "model_version": enc_text(c("model_version")),
        }
    )


def batches(members: DataFrame) -> DataFrame:
    """One row per batch (at most 200 members) with its ordered alert ids and its id."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "alert_id"))), lambda m: m["alert_id"]
    )
    return (
        members.groupBy(*GROUP, "partition_index", "partition_count", "prompt_version", "model_version")
        .agg(F.count("*").alias("alert_count"), ordered.alias("alert_ids"))
        .withColumn("batch_id", batch_hash(c("alert_ids")))
    )


def reversed_batches(table: DataFrame) -> DataFrame:
    """The reversed-order evaluation trial of the same partitions."""
    flipped = table.withColumn("alert_ids", F.reverse("alert_ids"))
    return flipped.withColumn("batch_id", batch_hash(c("alert_ids")))


def with_batch_id(members: DataFrame, table: DataFrame) -> DataFrame:
    keys = [*GROUP, "partition_index"]
    return members.join(table.select(*keys, "batch_id"), keys)


def document_entries(members: DataFrame) -> DataFrame:
    """One row per (member, top-level document field): the field and its JSON value."""
    view = members.select(
        *BATCH, "alert_id", "rank", "alert_schema", F.parse_json("document").alias("doc")
    )
    entries = view.sparkSession.sql(
        "SELECT v.*, e.key, to_json(e.value) AS value "
        "FROM {view} v, LATERAL variant_explode(v.doc) e",
        view=view,
    )
    return entries.drop("doc")


def shared_fields(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Fields with one and the same value in every member of a batch."""
    per_key = entries.groupBy(*BATCH, "key").agg(
        F.count("*").alias("present"), F.min("value").alias("value"), F.max("value").alias("high")
    )
    return (
        per_key.join(sizes.select(*BATCH, "alert_count"), BATCH)
        .where((c("present") == c("alert_count")) & (c("value") == c("high")))
        .select(*BATCH, "key", "value")
    )


def own_fields(entries: DataFrame, shared: DataFrame) -> DataFrame:
    return entries.join(shared.select(*BATCH, "key"), [*BATCH, "key"], "left_anti")


def _quoted(text: Column) -> Column:
    """The text as a JSON string: the only element of a JSON array, without its brackets."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _object_text(entries: Column) -> Column:
    """Sorted ``key: value`` entries as a JSON object."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(entries), ","), F.lit("}"))


def requests(members: DataFrame, table: DataFrame) -> DataFrame:
    """The exact request text of every batch, shared fields factored out."""
    entries = document_entries(members)
    shared = shared_fields(entries, table)
    pair = F.concat(_quoted(c("key")), F.lit(":"), c("value"))
    header = shared.groupBy(*BATCH).agg(_object_text(F.collect_list(pair)).alias("header"))
    per_alert = (
        own_fields(entries, shared)
        .groupBy(*BATCH, "alert_id")
        .agg(_object_text(F.collect_list(pair)).alias("fields"))
    )
    listed = members.select(*BATCH, "alert_id", "rank", "alert_schema").join(
        per_alert, [*BATCH, "alert_id"], "left"
    )
    alert = F.concat(
        F.lit('{"alert_id":'),
        _quoted(c("alert_id")),
        F.lit(',"schema":'),
        _quoted(c("alert_schema")),
        F.lit(',"fields":'),
        F.coalesce("fields", F.lit("{}")),
        F.lit("}"),
    )
    body = listed.groupBy(*BATCH).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", alert.alias("t")))),
                lambda a: a["t"],
            ),
            ",",
        ).alias("alerts")
    )
    text = F.concat(
        F.lit('{"batch_id":'),
        _quoted(c("batch_id")),
        F.lit(',"group":{"type":'),
        _quoted(c("group_type")),
        F.lit(',"value":'),
        _quoted(c("group_value")),
        F.lit('},"ruleset_version":'),
        _quoted(F.lit(K.RULESET_VERSION)),
        F.lit(',"prompt_version":'),
        _quoted(c("prompt_version")),
        F.lit(',"shared_fields":'),
        F.coalesce("header", F.lit("{}")),
        F.lit(',"alerts":['),
        c("alerts"),
        F.lit("]}"),
    )
    return (
        table.join(body, BATCH)
        .join(header, BATCH, "left")
        .withColumn("request_text", text)
        .withColumn("request_hash", F.sha2("request_text", 256))
        .drop("alerts", "header")
    )


def rebuild_problems(entries: DataFrame, members: DataFrame, header: DataFrame, own: DataFrame) -> DataFrame:
    """Fields that ``header`` and a member's ``own`` fields would not rebuild, or would invent."""
    keys = [*BATCH, "alert_id", "key", "value"]
    from_header = members.select(*BATCH, "alert_id").join(header, BATCH).select(*keys)
    rebuilt = from_header.union(own.select(*keys))
    original = entries.select(*keys)
    lost = original.join(rebuilt, keys, "left_anti").withColumn("problem", F.lit("lost"))
    invented = rebuilt.join(original, keys, "left_anti").withColumn("problem", F.lit("invented"))
    return lost.union(invented)


def lossless_violations(members: DataFrame, table: DataFrame) -> DataFrame:
    """The problems of the requests as they are built; empty when these are lossless."""
    entries = document_entries(members)
    shared = shared_fields(entries, table)
    return rebuild_problems(entries, members, shared, own_fields(entries, shared))


# ------------------------------------------------------------------ calling and validating


class Answers:
    """Responses kept by batch and attempt under a shared folder: put if absent, and read before calling."""

    def __init__(self, folder: str) -> None:
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.root, recursive=True)

    def _name(self, run_id: str, batch_id: str, attempt: int) -> str:
        return f"{self.root}/{attempt}-{run_id}-{batch_id}.json"

    def get(self, run_id: str, batch_id: str, attempt: int) -> dict | None:
        name = self._name(run_id, batch_id, attempt)
        if self.system.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with self.system.open_input_file(name) as file:
            return json.loads(file.read())

    def put(self, run_id: str, batch_id: str, attempt: int, answer: dict) -> dict:
        """The answer that stays: the first one. It appears under its name when it is complete."""
        if (stored := self.get(run_id, batch_id, attempt)) is not None:
            return stored
        draft = f"{self.root}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as out:
            out.write(json.dumps(answer).encode())
        self.system.move(draft, self._name(run_id, batch_id, attempt))
        return answer


def call_batches(
    todo: DataFrame, call: Call, attempt: int, concurrent: int = CONCURRENT_CALLS, folder: str | None = None
) -> DataFrame:
    """One attempt of every batch in ``todo``, dealt to ``concurrent`` tasks; a failed call is a
    row, never an exception.

    With ``folder`` (shared by all executors) a batch that has an answer to this attempt is not asked
    again, whichever task gave it: a task that runs twice calls once.
    """
    columns = [*BATCH, "request_text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Answers(folder) if folder else None
        for frame in frames:
            rows = []
            for run_id, batch_id, text in frame[columns].itertuples(index=False):
                answer = kept.get(run_id, batch_id, attempt) if kept else None
                if answer is None:
                    started = time.monotonic()
                    answer = {"response": None, "status": "succeeded", "reason": None}
                    try:
                        answer["response"] = call(text, batch_id, attempt)
                    except ClassifierError as error:
                        answer["status"], answer["reason"] = error.kind, str(error)[:1000]
                    answer["ms"] = int((time.monotonic() - started) * 1000)
                    answer = kept.put(run_id, batch_id, attempt, answer) if kept else answer
                rows.append((run_id, batch_id, attempt, *(answer[k] for k in ("response", "status", "reason", "ms"))))
            yield pd.DataFrame(
                rows,
                columns=[*BATCH, "attempt_number", "response_text", "status",
                         "failure_reason", "duration_ms"],
            )

    return todo.select(*columns).repartition(concurrent, *BATCH).mapInPandas(
        run,
        "run_id string, batch_id string, attempt_number int, response_text string, "
        "status string, failure_reason string, duration_ms long",
    )


def response_verdicts(responses: DataFrame) -> DataFrame:
    """Verdicts of every response, one row each, with the text fields and their problem."""
    parsed = responses.select(
        *BATCH, F.try_parse_json("response_text").alias("doc")
    )
    spread = parsed.sparkSession.sql(
        "SELECT p.run_id, p.batch_id, e.value AS verdict FROM {p} p, "
        "LATERAL variant_explode(try_variant_get(p.doc, '$.verdicts', 'variant')) e "
        "WHERE startswith(schema_of_variant(try_variant_get(p.doc, '$.verdicts', 'variant')), 'ARRAY')",
        p=parsed,
    )
    keys = F.array_sort(F.json_object_keys(F.to_json("verdict")))
    wanted = F.array(*[F.lit(k) for k in sorted(FIELDS)])
    values = {k: F.try_variant_get("verdict", f"$.{k}", "string") for k in FIELDS}
    types = {
        k: F.schema_of_variant(F.try_variant_get("verdict", f"$.{k}", "variant")) == "STRING"
        for k in FIELDS
    }
    flat = spread.select(
        *BATCH,
        keys.alias("keys"),
        *[v.alias(k) for k, v in values.items()],
        *[F.coalesce(t, F.lit(False)).alias(f"is_text_{k}") for k, t in types.items()],
    )
    a, p = c("assessment"), c("principle_id")
    problem = (
        F.when(c("keys").isNull(), "a verdict is not an object")
        .when(c("keys") != wanted, "a verdict has unexpected or missing fields")
        .when(~c("is_text_alert_id") | (c("alert_id") == ""), "alert_id is not a non-empty string")
        .when(~c("is_text_assessment") | ~a.isin(*K.ASSESSMENTS), "assessment is not valid")
        .when(
            ~c("is_text_confidence") | ~c("confidence").isin(*K.CONFIDENCES),
            "confidence is not valid",
        )
        .when(~c("is_text_principle_id"), "principle_id is not a string")
        .when(
            ~c("is_text_justification") | is_blank(c("justification")), "justification is empty"
        )
        .when(F.length("justification") > K.MAX_JUSTIFICATION, "justification is too long")
        .when((a == "no_violation") & (p != "NONE"), "no_violation must carry NONE")
        .when((a == "other") & (p != "OTHER"), "other must carry OTHER")
        .when((a == "catalog_violation") & ~p.isin(*K.CITABLE), "principle is not citable")
    )
    return flat.select(*BATCH, *FIELDS, problem.alias("problem"))


def not_applicable(principle: Column) -> Column:
    """A principle cited outside its scope."""
    return (
        (principle.isin("P7", "P8", "P9", *K.READINESS_RULES) & (c("alert_schema") != "v2"))
        | ((principle == "P7") & ~F.coalesce(c("severity") == "critical", F.lit(False)))
        | ((principle == "R7") & (c("alert_schema") != "v1"))
        | ((principle == "R4") & ~field_in(c("provider"), ("grafana",)))
    )


def validate_responses(responses: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, batch_results)``. The contract is closed: one bad verdict, an unknown,
    missing or repeated alert, or a foreign batch id rejects the whole batch."""
    doc = F.try_parse_json("response_text")
    keys = F.array_sort(F.json_object_keys("response_text"))
    envelope = responses.select(
        *BATCH,
        F.when(c("status") != "succeeded", c("failure_reason"))
        .when(doc.isNull(), "response is not valid JSON")
        .when(keys.isNull(), "response is not a JSON object")
        .when(
            keys != F.array(F.lit("batch_id"), F.lit("verdicts")),
            "response has unexpected or missing top-level fields",
        )
        .when(
            ~F.coalesce(
                F.try_variant_get(doc, "$.batch_id", "string") == c("batch_id"), F.lit(False)
            ),
            "response batch_id does not match the request",
        )
        .when(
            ~F.coalesce(
                F.schema_of_variant(F.try_variant_get(doc, "$.verdicts", "variant")).startswith(
                    "ARRAY"
                ),
                F.lit(False),
            ),
            "verdicts is not an array",
        )
        .alias("envelope_problem"),
    )
    answered = response_verdicts(responses)
    counted = answered.groupBy(*BATCH, "alert_id").agg(
        F.count("*").alias("times"),
        F.min("problem").alias("problem"),
        *[F.min(k).alias(k) for k in FIELDS[1:]],
    )
    expected = members.join(responses.select(*BATCH), BATCH, "left_semi").select(
        *BATCH, *[k for k in ID if k != "run_id"], "alert_id", "severity", "provider"
    )
    matched = expected.withColumn("expected", F.lit(True)).join(
        counted.withColumn("answered", F.lit(True)), [*BATCH, "alert_id"], "full_outer"
    )
    trouble = (
        F.when(c("problem").isNotNull(), c("problem"))
        .when(c("times") > 1, "response contains a duplicate verdict")
        .when(c("expected").isNull(), "response contains a verdict for an unknown alert")
        .when(c("answered").isNull(), "response is missing a verdict")
        .when(not_applicable(c("principle_id")), "principle is not applicable to its alert")
    )
    checked = matched.withColumn("trouble", trouble)
    per_batch = checked.groupBy(*BATCH).agg(F.min("trouble").alias("trouble"))
    results = envelope.join(per_batch, BATCH, "left").select(
        *BATCH, F.coalesce("envelope_problem", "trouble").alias("rejected_because")
    )
    accepted = results.where(c("rejected_because").isNull()).select(*BATCH)
    verdicts = checked.join(accepted, BATCH, "left_semi").select(
        *BATCH, *[k for k in ID if k != "run_id"], *FIELDS
    )
    return verdicts, results


def assess(
    request_table: DataFrame, members: DataFrame, call: Call
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(verdicts, attempts, failed)`` after at most three identical attempts per batch.

    Each round's responses are written before they are read, and each answer is kept as it comes: no
    call is repeated because a task or a later stage was.
    """
    todo = request_table
    folder = f"{shared_dir(request_table.sparkSession)}/sirenlens/answers-{uuid.uuid4().hex}"
    verdicts: DataFrame | None = None
    attempts: DataFrame | None = None
    for attempt in range(1, K.MAX_ATTEMPTS + 1):
        answered = materialize(call_batches(todo, call, attempt, folder=folder), f"responses-{attempt}")
        good, results = validate_responses(answered, members)
        good, results = together(
            lambda g=good: materialize(g, "verdicts"), lambda r=results: materialize(r, "results")
        )
        logged = answered.join(results, BATCH).select(
            *BATCH,
            "attempt_number",
            F.when(c("status") != "succeeded", c("status"))
            .when(c("rejected_because").isNotNull(), "invalid_response")
            .otherwise("succeeded")
            .alias("status"),
            F.substring("rejected_because", 1, 1000).alias("failure_reason"),
            "response_text",
            "duration_ms",
        )
        verdicts = good if verdicts is None else verdicts.union(good)
        attempts = logged if attempts is None else attempts.union(logged)
        rejected = results.where(c("rejected_because").isNotNull()).select(*BATCH)
        if rejected.isEmpty():
            break
        todo = request_table.join(rejected, BATCH, "left_semi")
    assert verdicts is not None and attempts is not None
    last = attempts.where((c("attempt_number") == K.MAX_ATTEMPTS) & (c("status") != "succeeded"))
    failed = last.select(
        *BATCH,
        F.substring(
            F.concat(
                F.lit(f"batch exhausted {K.MAX_ATTEMPTS} attempts - "),
                c("status"),
                F.lit(": "),
                F.coalesce("failure_reason", F.lit("")),
            ),
            1,
            500,
        ).alias("unassessed_reason"),
    )
    return verdicts, attempts, failed


def verdict_state(assessment: Column, confidence: Column) -> Column:
    return (
        F.when(assessment == "no_violation", "assessed_good")
        .when(assessment == "other", "needs_review")
        .when(confidence == "high", "llm_flagged")
        .otherwise("needs_review")
    )


OUTCOME = ("state", "principle_id", "confidence", "justification", "unassessed_reason", "reused")


def outcomes_of(
    verdicts: DataFrame, reused: DataFrame, failed: DataFrame, members: DataFrame
) -> DataFrame:
    """One outcome per eligible identity."""

    def judged(df: DataFrame, again: bool) -> DataFrame:
        return df.select(
            *ID,
            verdict_state(c("assessment"), c("confidence")).alias("state"),
            "principle_id",
            "confidence",
            "justification",
            F.lit(None).cast("string").alias("unassessed_reason"),
            F.lit(again).alias("reused"),
        )

    none = F.lit(None).cast("string")
    lost = members.join(failed, BATCH).select(
        *ID,
        F.lit("unassessed").alias("state"),
        none.alias("principle_id"),
        none.alias("confidence"),
        none.alias("justification"),
        "unassessed_reason",
        F.lit(False).alias("reused"),
    )
    return judged(verdicts, False).union(judged(reused, True)).union(lost)


def mark_unassessed(eligible: DataFrame, reason: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return eligible.select(
        *ID,
        F.lit("unassessed").alias("state"),
        none.alias("principle_id"),
        none.alias("confidence"),
        none.alias("justification"),
        F.lit(reason).alias("unassessed_reason"),
        F.lit(False).alias("reused"),
    )
