"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Stack traces for every column cost more than planning a query of this size.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# On a cluster, shuffles start with many partitions and AQE joins them to this size. Streams keep
# spark.sql.shuffle.partitions, which fixes the number of their state stores.
CLUSTER = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(app: str = "fleetscore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes; on a cluster, master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = DEFAULTS if master and master.startswith("local") else {**DEFAULTS, **CLUSTER}
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names, a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fleetscore-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder, for tables and stream state of one run."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffles goes when the query is done, rather than when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_known_size(df: DataFrame, purpose: str) -> DataFrame:
    """df written once and read back: joins then go by its real size, and broadcast it only if that is small.

    Meant for a small table next to a wide one, which an estimate would have shuffled.
    """
    return _stored(df, scratch_path(df.sparkSession, purpose))


@contextmanager
def stored_meanwhile(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """As `with_known_size`, for a table that nobody reads after the block: it is removed then."""
    path = scratch_path(df.sparkSession, purpose)
    try:
        yield _stored(df, path)
    finally:
        remove(df.sparkSession, path)
