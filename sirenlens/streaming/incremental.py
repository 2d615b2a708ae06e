"""The same facts from a stream.

Each micro-batch is reduced to mergeable partials (signatures, instants, scopes, the newest and the
shown rows) that are written as one run of a log. Runs are merged, a few of one level into one of the
next, as in a log-structured store; a manifest, committed last, names those that count, so a replayed
batch overwrites its own run and a failed merge leaves nothing behind. When the watermark has passed a
week's end, the finalizer adds up the runs and computes its facts, once; whatever needs the whole
window (the blast-radius guard) happens only there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sirenlens.operators import classify as L
from sirenlens.operators import episodes as E
from sirenlens.operators import facts as W
from sirenlens.operators import rowfacts as R
from sirenlens.operators import suppression as V
from sirenlens.operators import volume as D
from sirenlens.plans.team_week import Analysis, Facts, facts_of
from sirenlens.session import state_partitions, together
from sirenlens.sources.registry import Registry
from sirenlens.sources.schema import IDENTITY

c = F.col
ID = list(IDENTITY)
SIGNATURE_KEYS = ["team_id", *ID, "snapshot_date", "rule_mask", "hit_leaves", "hidden"]
#: Runs of one level that are merged into one of the next.
FAN = 4


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream, in arrival order."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# ------------------------------------------------------------------ partial facts


PROGRESS = "max_us BIGINT, late BIGINT, kept BIGINT"
MANIFEST = "run STRING, level INT"


def counts_of(rows: DataFrame) -> dict[str, DataFrame]:
    """What a set of narrow rows contributes to the facts; ``MERGE`` adds such tables up."""
    return {
        "signatures": V.signatures_of(rows),
        "instants": E.instants_of(rows),
        "scopes": D.scopes_of(rows),
        "newest": R.newest(rows),
        "first_findings": R.first_findings(rows),
    }


def _merge_first(df: DataFrame) -> DataFrame:
    placed = df.withColumnsRenamed({"first_ts": "ts", "first_seq": "seq"}).withColumn("place", R.place())
    least = placed.groupBy(*ID, "rule_id").agg(F.sum("matched_rows").alias("matched_rows"), F.min("place").alias("place"))
    return R.with_place(least)


MERGE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "signatures": lambda df: df.groupBy(*SIGNATURE_KEYS).agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    ),
    # rows of one instant meet whatever batches they came in, so fires precede clears at an instant
    # across batches too
    "instants": lambda df: df.groupBy(*ID, "us", "slice").agg(
        F.sum("fires").alias("fires"), F.sum("clears").alias("clears")
    ),
    "scopes": lambda df: df.groupBy(*D.DAY, "application", "component", "node").agg(F.sum("n").alias("n")),
    "newest": lambda df: df.groupBy("team_id", *ID).agg(F.max("ts").alias("ts")),
    "first_findings": _merge_first,
}


class Log:
    """The partial facts under ``folder``: ``runs/<run>/<table>``, and manifests by version."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def manifest(self, below: int | None = None) -> list[tuple[str, int]]:
        """``(run, level)`` of the newest manifest, or of the newest below a version."""
        try:
            rows = self.spark.read.schema(f"{MANIFEST}, version BIGINT").parquet(f"{self.folder}/manifest")
        except AnalysisException:  # nothing committed yet
            return []
        rows = rows if below is None else rows.where(c("version") < below)
        newest = rows.agg(F.max("version")).first()[0]
        return sorted((r.run, r.level) for r in rows.where(c("version") == newest).collect()) if newest is not None else []

    def commit(self, version: int, runs: list[tuple[str, int]]) -> None:
        rows = self.spark.createDataFrame(runs, MANIFEST).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")

    def read(self, table: str, runs: list[str] | None = None) -> DataFrame:
        """A table over ``runs`` (all that count), merged."""
        names = runs if runs is not None else [run for run, _ in self.manifest()]
        held = self.spark.read.parquet(*[f"{self.folder}/runs/{n}/{table}" for n in names])
        if table == "shown":
            return held.join(self._shown_instants(names), [*ID, "ts"], "left_semi") if len(names) > 1 else held
        return MERGE[table](held) if len(names) > 1 else held

    def _shown_instants(self, names: list[str]) -> DataFrame:
        last, first = self.read("newest", names), self.read("first_findings", names)
        return last.select(*ID, "ts").union(first.select(*ID, c("first_ts").alias("ts"))).distinct()

    def write(self, run: str, tables: dict[str, DataFrame]) -> None:
        folder = f"{self.folder}/runs/{run}"
        together(*[lambda n=n, df=df: df.write.mode("overwrite").parquet(f"{folder}/{n}") for n, df in tables.items()])

    def write_partials(self, run: str, owned: DataFrame, plans: DataFrame) -> None:
        """The partial facts of a batch's owned rows, in two passes over them: one judges every row, and all
        counts read what it wrote; one fetches the rows that are shown."""
        self.write(run, {"rows": R.narrow_rows(owned, plans)})
        self.write(run, counts_of(self.spark.read.parquet(f"{self.folder}/runs/{run}/rows")))
        last, first = self.read("newest", [run]), self.read("first_findings", [run])
        self.write(run, {"shown": R.shown_rows(owned, last, first)})
        self._drop(f"{run}/rows")

    def _drop(self, name: str) -> None:
        system, path = fs.FileSystem.from_uri(f"{self.folder}/runs/{name}")
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)

    def add(self, version: int, run: str) -> None:
        """Add a written run, merge levels that are full, commit, and drop what no replay can ask for.

        The run of a batch that is replayed has its name already; the manifest before it decides.
        """
        before = self.manifest(below=version)
        runs = [*[r for r in before if r[0] != run], (run, 0)]
        level, made = 0, {run}
        while len(full := [r for r, n in runs if n == level]) >= FAN:
            joined = f"level{level + 1}-{version:09d}"
            self.write(joined, {t: self.read(t, full) for t in (*MERGE, "shown")})
            runs = [(r, n) for r, n in runs if n != level] + [(joined, level + 1)]
            level, made = level + 1, made | {joined}
        self.commit(version, runs)
        # a replay of this batch needs the manifest before it, and makes what this step has made anew
        gone = ({r for r, _ in self.manifest(below=version - 1)} | made) - {r for r, _ in [*before, *runs]}
        for name in gone:
            self._drop(name)


def watermark_us(spark: SparkSession, folder: str, batch_id: int | None, delay_us: int) -> int | None:
    """The newest instant of earlier batches (of all of them, without a batch) minus the delay: the
    same on every replay."""
    try:
        seen = spark.read.schema(f"{PROGRESS}, batch BIGINT").parquet(f"{folder}/progress")
    except AnalysisException:
        return None
    seen = seen if batch_id is None else seen.where(c("batch") < batch_id)
    newest = seen.agg(F.max("max_us")).first()[0]
    return None if newest is None else newest - delay_us


def ingest_batch(scope, plans: DataFrame, folder: str, delay_us: int):
    """The foreachBatch step. ``scope`` maps a micro-batch to owned alerts.

    A micro-batch is computed whole by each pass over it, whatever columns that needs. So it should be the
    source's rows with their instant ``ts``; ``scope`` makes alerts of them.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = watermark_us(spark, folder, batch_id, delay_us)
        late = F.lit(False) if mark is None else F.unix_micros("ts") < mark
        progress = batch.agg(
            F.max(F.unix_micros("ts")).alias("max_us"),
            F.count_if(late).alias("late"),
            F.count_if(~late).alias("kept"),
        )
        log, run = Log(spark, folder), f"batch-{batch_id:09d}"
        log.write_partials(run, scope(batch.where(~late)), plans)
        log.add(batch_id, run)
        # progress last: it marks the batch complete for the batches after it
        progress.write.mode("overwrite").parquet(f"{folder}/progress/batch={batch_id}")

    return step


def ingest(
    rows: DataFrame, scope, plans: DataFrame, folder: str, delay_us: int, partitions: int | None = None
) -> None:
    """Drain the available input into partial facts and stop."""
    with state_partitions(rows.sparkSession, partitions):
        (
            rows.writeStream.foreachBatch(ingest_batch(scope, plans, folder, delay_us))
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )


def merged_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """All batches' signatures added up: what one pass over all rows would give."""
    return Log(spark, folder).read("signatures")


def merged_instants(spark: SparkSession, folder: str) -> DataFrame:
    return Log(spark, folder).read("instants")


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    held = spark.read.schema(f"{PROGRESS}, batch BIGINT").parquet(f"{folder}/progress")
    return held.agg(F.sum("late").alias("late"), F.sum("kept").alias("kept"))


class StreamAnalysis(Analysis):
    """The analysis of ``runs`` from partial facts: what a batch reads from rows is added up from runs."""

    def __init__(self, spark: SparkSession, folder: str, reg: Registry, runs: DataFrame, cut: bool = True) -> None:
        super().__init__(None, reg, runs, None, cut)  # no rows and no span: they are gone
        self.log = Log(spark, folder)

    def _of_runs(self, table: str) -> DataFrame:
        mine = self.log.read(table).join(self.runs.select("run_id"), "run_id", "left_semi")
        return self._keep(mine, f"stream-{table}")

    @cached_property
    def signatures(self) -> DataFrame:
        return self._of_runs("signatures")

    @cached_property
    def newest(self) -> DataFrame:
        return self._of_runs("newest")

    @cached_property
    def first_findings(self) -> DataFrame:
        return self._of_runs("first_findings")

    @cached_property
    def shown(self) -> DataFrame:
        return self._of_runs("shown")

    @cached_property
    def episodes(self) -> DataFrame:
        return self._keep(E.firing_of_instants(self._of_runs("instants"), keep=self._keep), "episodes")

    @cached_property
    def scope_days(self) -> DataFrame:
        return self._keep(D.counts_of_scopes(self._of_runs("scopes")), "scope-days")


def finalize_due(
    spark: SparkSession, folder: str, reg: Registry, runs: DataFrame, delay_us: int, call: L.Call | None = None
) -> Facts | None:
    """The facts of every week whose end the watermark has passed and that has none yet; None without one.

    A week is replaced as a whole and marked afterwards, so a finalizer that fails does it again.
    """
    mark = watermark_us(spark, folder, None, delay_us)
    if mark is None:
        return None
    due = runs.where(F.unix_micros("window_end") <= mark)
    try:
        due = due.join(spark.read.parquet(f"{folder}/finalized"), "run_id", "left_anti")
    except AnalysisException:  # nothing finalized yet
        pass
    if due.isEmpty():
        return None
    facts = facts_of(StreamAnalysis(spark, folder, reg, due), call)
    tables = {
        "runs": facts.runs, "daily_metrics": facts.daily_metrics, "daily_rule_counts": facts.daily_rule_counts,
        "alert_findings": facts.alert_findings, "run_panels": facts.run_panels,
    }
    for name, df in tables.items():
        W.replace_runs(df, f"{folder}/facts/{name}")
    due.select("run_id").write.mode("append").parquet(f"{folder}/finalized")
    return facts


def stored_facts(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/facts/{table}")


def finalize_firing(spark: SparkSession, folder: str) -> DataFrame:
    scanned = E.scan_slices(merged_instants(spark, folder))
    return E.firing_from_slices(E.summarize_slices(scanned), scanned.where(c("cycle")))


# ------------------------------------------------------------------ keyed state

SLICE_SCHEMA = (
    "run_id string, alert_schema string, application string, key_field string, slice long, "
    "fires long, clears long, first_us long, last_us long, closed boolean, head_fires long, "
    "head_us long, tail_fires long, tail_us long, inner_fires long, edge_clear boolean, "
    "cycle_us array<long>"
)
def summarize_instants(points: list[tuple[int, int, int]]) -> dict:
    """One slice's ordered instants ``(us, fires, clears)`` as a slice summary."""
    closed_runs: list[tuple[int, int | None]] = []
    cycles: list[int] = []
    fires, since = 0, None
    for us, fired, cleared in points:
        if fired:
            since = us if since is None else since
            fires += fired
        if cleared:
            if fires:
                cycles.append(us)
            closed_runs.append((fires, since))
            fires, since = 0, None
    runs = [*closed_runs, (fires, since)] if fires else closed_runs
    return {
        "fires": sum(p[1] for p in points),
        "clears": sum(p[2] for p in points),
        "first_us": points[0][0],
        "last_us": points[-1][0],
        "closed": bool(closed_runs),
        "head_fires": runs[0][0],
        "head_us": runs[0][1],
        "tail_fires": fires or None,
        "tail_us": since,
        "inner_fires": max((r[0] for r in closed_runs[1:]), default=None),
        "edge_clear": points[0][1] == 0 and points[0][2] > 0,
        "cycle_us": cycles,
    }


class SliceProcessor(StatefulProcessor):
    """Hold a slice's instants until the watermark has passed it, then emit its summary.

    The instants are a map by their microsecond: a batch writes the ones that it brings and no others.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "us long", "fires long, clears long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh: dict[int, tuple[int, int]] = {}
        for frame in rows:
            summed = frame.groupby("us", as_index=False)[["fires", "clears"]].sum()
            for us, fires, clears in zip(summed["us"], summed["fires"], summed["clears"], strict=True):
                f, k = fresh.get(int(us), (0, 0))
                fresh[int(us)] = (f + int(fires), k + int(clears))
        if not self.points.exists():  # the first rows of a slice set its timer
            end_ms = (int(key[4]) + 1) * E.SLICE_US // 1000
            self.handle.registerTimer(max(end_ms, timerValues.getCurrentWatermarkInMs() + 1))
        for us, (fires, clears) in fresh.items():
            if self.points.containsKey((us,)):
                f, k = self.points.getValue((us,))
                fires, clears = fires + f, clears + k
            self.points.updateValue((us,), (fires, clears))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        points = sorted((us[0], *value) for us, value in self.points.iterator())
        self.points.clear()
        names = ("run_id", "alert_schema", "application", "key_field", "slice")
        frame = pd.DataFrame([{**dict(zip(names, key, strict=True)), **summarize_instants(points)}])
        for name in ("head_us", "tail_fires", "tail_us", "inner_fires"):
            frame[name] = frame[name].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


INSTANT_KEYS = ["alert_schema", "operator", "application", "key_field"]


def instant_stream(alerts: DataFrame) -> DataFrame:
    """First hop: rows become instants in a streaming aggregate, which pre-aggregates in each map
    task and releases an instant once the watermark on ``ts`` has passed it."""
    return (
        alerts.withColumn("clear", E.is_clear())
        .groupBy(*INSTANT_KEYS, "ts")
        .agg(F.count_if(~c("clear")).alias("fires"), F.count_if(c("clear")).alias("clears"))
    )


def slice_stream(owned: DataFrame) -> DataFrame:
    """Second hop: slice summaries of a stream of owned instants that carries a watermark on
    ``ts``.

    State is keyed by identity and slice, so it is bounded by a slice's clock resolution and a
    hot identity spreads over its slices.
    """
    placed = owned.select(
        *ID, "ts", F.unix_micros("ts").alias("us"), "fires", "clears"
    ).withColumn("slice", E.slice_of(c("us")))
    return placed.groupBy(*ID, "slice").transformWithStateInPandas(
        SliceProcessor(), SLICE_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


def firing_of_slices(slices: DataFrame) -> DataFrame:
    local = slices.select(*ID, F.explode("cycle_us").alias("us"))
    return E.firing_from_slices(slices.drop("cycle_us"), local)


def drain(stream: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Run an append stream over the available input into Parquet and read it back."""
    with state_partitions(stream.sparkSession, partitions):
        (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{path}-checkpoint")
            .option("path", path)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# ------------------------------------------------------------------ windows


def distinct_per_day(alerts: DataFrame) -> DataFrame:
    """Exact distinct alerts per schema and UTC day over a watermarked stream.

    Identities are deduplicated per day first (kept for the watermark delay, which must be at
    least a day), so the daily aggregate only ever counts.
    """
    keyed = alerts.withColumn("day", F.to_date("ts"))
    once = keyed.dropDuplicatesWithinWatermark(["alert_schema", "day", "application", "key_field"])
    return (
        once.groupBy(F.window("ts", "1 day").alias("w"), "alert_schema")
        .agg(F.count("*").alias("distinct_alerts"))
        .select(c("w.start").alias("day_start"), "alert_schema", "distinct_alerts")
    )
