"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4_000_000  # of one Arrow batch
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", app: str = "newsfunnel", **conf) -> SparkSession:
    """A session with the settings the operators assume; cluster deployments set their own."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` of the session.

    A local folder is made up only for a local master (tests, laptops): on a cluster, executors
    and driver share no such folder, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="newsfunnel-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run's intermediate tables; below the folder of
    the run in whose `stage_store` it is called."""
    store = _store.get()
    root = store.path if store else shared_dir(spark).rstrip("/")
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


class StageStore:
    """The folder of one run's stage tables. Several holders may share it; when the last one has
    released it, it is deleted as a whole."""

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark, self.path, self._holders = spark, run_dir(spark, label), 1

    def hold(self) -> StageStore:
        if not self._holders:
            raise RuntimeError(f"{self.path} is deleted already")
        self._holders += 1
        return self

    def release(self) -> None:
        if self._holders:
            self._holders -= 1
            if not self._holders:
                drop_path(self.spark, self.path)


_store: contextvars.ContextVar[StageStore | None] = contextvars.ContextVar("stage_store", default=None)


@contextlib.contextmanager
def stage_store(store: StageStore) -> Iterator[StageStore]:
    """Stage tables written inside go to `store`."""
    token = _store.set(store)
    try:
        yield store
    finally:
        _store.reset(token)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own below the shared folder, on whatever file system it is."""
    if not path.startswith(f"{shared_dir(spark).rstrip('/')}/"):
        raise ValueError(f"{path} is not below the shared folder")
    delete_tree(spark, path)


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_tree(spark: SparkSession, path: str) -> None:
    target, files = _file(spark, path)
    files.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _file(spark, path)
    return files.exists(target)


def ship_package(spark: SparkSession, name: str = "newsfunnel") -> None:
    """Make a package importable in the Python workers, wherever the driver was started."""
    context = spark.sparkContext
    shipped = context.__dict__.setdefault("_shipped_packages", set())
    if name in shipped:
        return
    source = os.path.dirname(os.path.abspath(sys.modules[name].__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="ship-"), name), "zip",
        root_dir=os.path.dirname(source), base_dir=os.path.basename(source),
    )
    context.addPyFile(archive)
    shipped.add(name)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that go to Python, unless the session bounds them itself: the
    JVM and the worker hold several copies of a batch each, and 10,000 whole texts are many bytes."""
    if "_batch_bytes" not in spark.__dict__:
        spark._batch_bytes = spark.conf.get(BATCH_SETTING)
        if spark._batch_bytes in ("67108864", "67108864b", "64MB"):  # Spark's default
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system. Workers wait for later tasks beside the executor's heap, and
    what one task freed would stay with its worker."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`mapInPandas` with this package available to the workers, over batches of bounded bytes."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def task(batches):
        yield from fn(batches)
        give_back()

    return df.mapInPandas(task, schema)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a source that has fewer splits than the session has cores (one small
    file, say) before heavy work per row. Sources with enough splits stay as they are, so on
    large data no shuffle is added."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` once as a table in the shared folder and go on from there.

    Lost executors then cost no recomputation of what is written, and every later stage sees the
    same rows. Unlike an RDD checkpoint the table is compressed, has true sizes for the optimizer,
    and later stages read only the columns they use. A task that is retried while the table is
    written runs again, with its calls of a scorer.
    """
    return write_stage(df, label)[0]


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: nothing reads them again, and Spark would keep
    those of every stage until the driver collects garbage. A session that sets this itself keeps its setting."""
    if spark.conf.get(SHUFFLE_SETTING, None) is not None:
        yield
        return
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_SETTING)


def write_stage(df: DataFrame, label: str = "stage", **measures) -> tuple[DataFrame, str, dict]:
    """(the stored table, its path, `measures` of its rows): aggregates are taken while the rows are
    written, so they cost no pass of their own."""
    path, seen = run_dir(df.sparkSession, label), Observation()
    if measures:
        df = df.observe(seen, *[c.alias(name) for name, c in measures.items()])
    with shuffles_freed(df.sparkSession):
        df.write.mode("error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get if measures else {}


def broadcast_if_few(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Narrow rows of a counted table: broadcast up to `most` of them, beyond that joined by a shuffle."""
    return F.broadcast(df) if rows <= most else df
