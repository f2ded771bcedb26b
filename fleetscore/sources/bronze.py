"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscore.operators.quality import key_violations
from fleetscore.operators.upsert import latest_per_key, newest_first, newest_rows
from fleetscore.sources import versions


def scan_bronze(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame:
    """A table by name: under a folder when `base` is a path, else in the catalog namespace `base`.

    With the schema of a folder's table known, no file footer is read to find it out.
    """
    if "/" not in base:
        return spark.read.table(f"{base}.{name}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{base}/{name}")


def create_table(spark: SparkSession, name: str, schema: str, partition_by: list[str] | None = None) -> None:
    """A typed empty table, if there is none of that name."""
    if not spark.catalog.tableExists(name):
        writer = spark.createDataFrame([], schema).write
        (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def overwrite(df: DataFrame, name: str) -> None:
    """A whole new snapshot in place of the table, schema included."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def create_or_replace(df: DataFrame, name: str, provider: str = "parquet") -> None:
    """The table as the result of a query; atomic where the catalog can replace tables."""
    try:
        df.writeTo(name).using(provider).createOrReplace()
    except Exception as refused:
        if "UNSUPPORTED_FEATURE" not in str(refused) and "REPLACE TABLE" not in str(refused):
            raise
        overwrite(df, name)


def replace_day(df: DataFrame, path: str, col: str = "snapshot_date") -> None:
    """Only the days in df are replaced, all at once; writing a day twice leaves it once. `read_merged` reads the table."""
    publish_partitions(df, path, col)


def merge_into(source: DataFrame, name: str, keys: list[str], order_by: str = "harvested_at") -> None:
    """MERGE by key into a catalog table whose format can change single rows."""
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"{name}.{k}") == F.col(f"s.{k}"))
    newest = latest_per_key(source, keys, order_by).alias("s")
    newest.mergeInto(name, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def merge_partitions(
    source: DataFrame, path: str, keys: list[str], partition: str = "created_date",
    order_by: str | None = "harvested_at", null_is_key: bool = False, stored: bool = False, slice_rows: int = 8_000_000,
) -> list:
    """Merge into a versioned Parquet table by writing anew only the partitions that source touches; returns these.

    For tables without MERGE. The newest version of a row stays, also when an older one comes later;
    among equals, or without `order_by`, source wins. A key must keep its partition, as a message keeps its
    day of creation. Rows that lack a part of the key are added, unless `null_is_key`. Writers of other partitions
    may commit meanwhile; a merge that meets one of its own partitions is done again (see `versions`).
    Source is kept while it is merged; with `stored`, it is read twice instead, as a stored table can be.
    Repeats within source and stored rows are told apart in one pass, so wide rows move once to their keys and once to their days.
    A source of more than `slice_rows` rows is merged in slices of its keys, whose rows move one slice after the other.
    """
    fresh = source if stored else source.persist()
    spark = source.sparkSession
    counted = fresh.groupBy(partition).count().collect()  # one value per partition, as in a listing
    days = [r[0] for r in counted]
    folders = [versions.folder_of(partition, day) for day in days]
    slices = -(-sum(r["count"] for r in counted) // slice_rows)

    def merged(state: versions.State) -> list[DataFrame]:
        held = versions.read(spark, path, state, fresh.schema, folders) if any(f in state.partitions for f in folders) else None

        def of(n: int) -> DataFrame:
            """The rows that stay of the keys of a slice. Rows of a key have one hash, also those that lack a part of it."""
            within = lambda df: df if slices == 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(slices)) == n)
            if held is None:
                return latest_per_key(within(fresh), keys, order_by, null_is_key)
            both = within(held).withColumn("_fresh", F.lit(0)).unionByName(within(fresh).withColumn("_fresh", F.lit(1)))
            return newest_rows(both, keys, newest_first(fresh, keys, order_by, F.col("_fresh").desc()), null_is_key).drop("_fresh")

        return [of(n) for n in range(slices)]

    if days:
        versions.publish(spark, path, partition, merged)
    if not stored:
        fresh.unpersist()
    return days


def publish_partitions(df: DataFrame, path: str, partition: str, days: list | None = None) -> None:
    """Put the partitions in df in the place of the stored ones, all at once; of `days`, those without rows go."""
    versions.publish(df.sparkSession, path, partition, lambda _: df, days)


def read_merged(spark: SparkSession, path: str, schema: StructType | None = None, partition: str | None = None, days=None) -> DataFrame:
    """The published rows of a versioned table, or of some days of it; with a schema, a table nobody has written yet is empty."""
    folders = None if days is None else [versions.folder_of(partition, day) for day in days]
    return versions.read(spark, path, versions.published(spark, path), schema, folders)


def export_snapshot(df: DataFrame, path: str, pk: list[str]) -> DataFrame:
    """Write a table for a keyed store, and return the keys that would collide there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return key_violations(df.sparkSession.read.parquet(path), pk)


def as_materialized_view(function: Callable[[], DataFrame]):
    """A gold function as a materialized view of a declarative pipeline, where one is running."""
    from pyspark import pipelines

    return pipelines.materialized_view(function)
