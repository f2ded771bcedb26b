"""Which landed files a harvest has taken in, and what of them couldn't be read.

The ledger has a row per file and state of it (path, time of change, length). A landing reads the files that are not in it
and enters them once their rows are stored; a landing lost before that is done again, which merges allow for. A file that was
changed or repaired is new. Lines that are no JSON go to a dead-letter table with their file; a landing of the repaired file takes
the rest in, and `open_quarantine` then has them no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.session import with_known_size
from fleetscore.sources import versions

FILES = "kind string, path string, modified timestamp, length bigint, landed_at timestamp"
DEAD = "kind string, path string, modified timestamp, payload string, landed_at timestamp"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if versions.listed(spark, path) else spark.createDataFrame([], schema)


def new_files(spark: SparkSession, folder: str, kind: str, ledger: str) -> DataFrame:
    """(kind, path, modified, length) of files under folder that the ledger doesn't have in this state. Contents aren't read."""
    if not versions.listed(spark, folder):
        return spark.createDataFrame([], FILES).drop("landed_at")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(
        F.lit(kind).alias("kind"), "path", F.col("modificationTime").alias("modified"), "length")
    # Settled: a listing done again could have files that were never read.
    return with_known_size(found.join(_stored(spark, ledger, FILES), ["kind", "path", "modified", "length"], "left_anti"), "new-files")


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The lines of these files as (payload, path); file names, not contents, pass the driver."""
    paths = [r.path for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "payload string, path string")
    return spark.read.text(paths).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))


def _broken() -> Column:
    return (F.trim("payload") != "") & F.try_parse_json("payload").isNull()


def readable(lines: DataFrame) -> DataFrame:
    return lines.where(~_broken())


def quarantine(lines: DataFrame, files: DataFrame, path: str) -> None:
    """Append the lines that are no JSON to the dead-letter table."""
    bad = lines.where(_broken()).join(files.select("kind", "path", "modified"), "path")
    bad.select("kind", "path", "modified", "payload", F.current_timestamp().alias("landed_at")).write.mode("append").parquet(path)


def enter(files: DataFrame, ledger: str) -> None:
    files.select("kind", "path", "modified", "length", F.current_timestamp().alias("landed_at")).write.mode("append").parquet(ledger)


def open_quarantine(spark: SparkSession, path: str, ledger: str) -> DataFrame:
    """Dead letters of the last state of each file: (kind, path, payload)."""
    last = _stored(spark, ledger, FILES).groupBy("kind", "path").agg(F.max("modified").alias("modified"))
    return _stored(spark, path, DEAD).select("kind", "path", "modified", "payload").distinct().join(
        last, ["kind", "path", "modified"], "left_semi").select("kind", "path", "payload")
