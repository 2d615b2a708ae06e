"""Session helpers: UTC semantics, local test session, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the jobs rely on.

    Every date bucket is a UTC date. Generated methods above 8,000 bytecodes are never compiled
    by the JVM's JIT, so such a stage runs faster operator by operator.
    """
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.codegen.hugeMethodLimit", "8000"),
    ):
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", name: str = "sirenlens") -> SparkSession:
    """A session for tests and the local benchmark; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.files.minPartitionNum", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; without one this is an error, as executors
    cannot read each other's disks. Only in local mode, where all share one disk, is a temporary
    folder used instead.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where one result feeds several later stages and must be identical in each of them.
    The table outlives a lost executor, and its size statistics are exact for the joins that
    follow.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sirenlens/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*jobs: Callable[[], T]) -> list[T]:
    """Run independent jobs side by side, so a small one does not wait for another's last task."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return list(pool.map(lambda job: job(), jobs))


@contextmanager
def state_partitions(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Start stateful streams with ``partitions`` partitions of state, kept in RocksDB.

    A stream keeps that number as long as its checkpoint: choose it for the largest state expected.
    None leaves the session's ``spark.sql.shuffle.partitions``.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_sirenlens_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "sirenlens.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(archive))
    context._sirenlens_shipped = True
    return spark
