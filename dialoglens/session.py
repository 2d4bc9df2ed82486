"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key also where the aggregation behind it then needs its own shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster leave `shuffle_partitions` unset: AQE coalesces from a high default.
    """
    builder = SparkSession.builder.appName("dialoglens")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and stream state.

    A cluster names it in `spark.checkpoint.dir`. A machine-local folder serves only a
    local session in which that setting is absent.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    local = tempfile.mkdtemp(prefix="dialoglens-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


_scratch = threading.local()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, inside the scratch root where one is open."""
    root = getattr(_scratch, "root", None) or work_dir(spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Frames materialized inside live in one folder, which is deleted at the end: use them up before."""
    outer = getattr(_scratch, "root", None)
    _scratch.root = root = fresh_path(spark, name)
    try:
        yield
    finally:
        _scratch.root = outer
        delete_path(spark, root)


#: State of streams in RocksDB: on each executor's disk, with one bounded share of memory for all of its partitions.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # counting the keys would look up each one once more
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk; by default all keys of all partitions are held in memory.

    A checkpoint goes on with the kind of store that it began with.
    """
    before = {key: spark.conf.get(key, None) for key in STATE_ON_DISK}
    for key, value in STATE_ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def delete_path(spark: SparkSession, path: str) -> None:
    files, where = _files(spark, path)
    files.delete(where, True)


def empty_folder(spark: SparkSession, path: str) -> None:
    """A folder without files at `path`, in place of what was there."""
    files, where = _files(spark, path)
    files.delete(where, True)
    files.mkdirs(where)


def list_folders(spark: SparkSession, path: str, prefix: str, complete: bool = False) -> list[str]:
    """Names of the folders in `path` that begin with `prefix`, of finished writes only if `complete`."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(where) if entry.isDirectory()]
    done = lambda name: files.exists(_files(spark, f"{path}/{name}/_SUCCESS")[1])
    return sorted(name for name in names if name.startswith(prefix) and (not complete or done(name)))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and continue from the files.

    Used where a frame feeds several branches: a lost executor then re-reads files
    instead of repeating the shuffles behind them.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
