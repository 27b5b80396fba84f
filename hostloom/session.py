"""Session settings, the shared folder and intermediate tables in it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# What the jobs rely on. Values are Spark's own settings; a cluster's
# defaults file may set others (partition counts above all).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON key: the last one wins, as in the collectors' own decoder
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # a streaming session window merges inside each task before its shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def configured(spark: SparkSession, *keys: str) -> Iterator[None]:
    """The named ``SETTINGS`` hold inside the block. A stream started there keeps them, since it copies the session."""
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, SETTINGS[key])
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def local_session(cores: str | int = "*", app: str = "hostloom", shared: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks; ``shared`` is its folder for intermediate tables."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        # test tables are single files; views deal them over that many tasks
        .config("spark.hostloom.view.partitions", "8")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="hostloom-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder under the checkpoint folder all executors can reach.

    ``spark.checkpoint.dir`` names that folder. Only a local session, where
    driver and executors are one machine, may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders of intermediate tables made inside go when the block ends, so a long stream leaves none."""
    outer = getattr(_scratch, "paths", None)
    _scratch.paths = []
    try:
        yield
    finally:
        made, _scratch.paths = _scratch.paths, outer
        for path in made:
            remove_folder(spark, path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that goes with the ``scratch`` block around it, else when the application ends."""
    path = shared_dir(spark, name)
    made = getattr(_scratch, "paths", None)
    if made is None:
        fs, at = file_system(spark, path)
        fs.deleteOnExit(at)
    else:
        made.append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; see ``scratch_dir`` for how long it stays."""
    path = scratch_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
