"""What a session must provide to the operators."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

_local_scratch: str | None = None
_within = threading.local()


def local_session(cores: int | str = "*", app: str = "fleetlens", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session_with(spark: SparkSession, conf: dict[str, str | int]) -> SparkSession:
    """A session like this one but for some settings: for reads that have no options for them."""
    changed = SparkSession(spark.sparkContext, jsparkSession=spark._jsparkSession.cloneSession())
    for key, value in conf.items():
        changed.conf.set(key, value)
    return changed


def scratch_dir(spark: SparkSession) -> str:
    """A new folder of this application below the shared one in ``spark.checkpoint.dir``.

    Only a local master may go without that setting; there the driver and the
    tasks are one machine. ``fleetlens/<application id>`` may be removed when
    the application has ended.
    """
    global _local_scratch
    if getattr(_within, "folder", None):
        return f"{_within.folder}/{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="fleetlens-")
        root = _local_scratch
    return f"{root.rstrip('/')}/fleetlens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of tables, wherever Spark keeps them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What this thread materializes inside is deleted at the end: for steps that are repeated for as long as a stream runs.

    The value is a ``materialize`` for what stays.
    """
    outer, folder = getattr(_within, "folder", None), scratch_dir(spark)
    _within.folder = folder

    def keep(df: DataFrame) -> DataFrame:
        _within.folder = outer
        try:
            return materialize(df)
        finally:
            _within.folder = folder

    try:
        yield keep
    finally:
        _within.folder = outer
        remove(spark, folder)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back.

    Cuts lineage (a lost executor re-reads files, nothing is recomputed), stops
    an expensive branch from being evaluated once per consumer, and gives the
    optimizer real file sizes for its own broadcast decision.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
