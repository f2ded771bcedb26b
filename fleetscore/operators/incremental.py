"""Which spaces and which conversations a run takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import instant_of


def parse_ids(text: str) -> list[str]:
    """Ids from a comma-separated setting; blanks are dropped."""
    return [part.strip() for part in text.split(",") if part.strip()]


def scope_by_ids(df: DataFrame, ids) -> DataFrame:
    """Rows of the named spaces. `ids` is a setting (text or list), or a DataFrame with space_id."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("space_id").distinct(), "space_id", "left_semi")
    names = parse_ids(ids) if isinstance(ids, str) else list(ids)
    return df.where(F.col("space_id").isin(names))


def scope_by_owner_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose folder starts with the prefix; rows without a folder are out."""
    return df.where(F.coalesce("parent_path", F.lit("")).startswith(prefix))


def scope(df: DataFrame, ids=None, prefix: str | None = None) -> DataFrame:
    """Ids decide where given, else the owner prefix, else everything is in scope."""
    if isinstance(ids, str):
        ids = parse_ids(ids)
    if ids is not None and (isinstance(ids, DataFrame) or len(ids) > 0):
        return scope_by_ids(df, ids)
    return scope_by_owner_prefix(df, prefix) if prefix else df


def incremental_cutoff(conversations: DataFrame | None, as_of=None, overlap: str = "2 hours") -> DataFrame:
    """One row: the newest harvest less an overlap for late updates. Null on an empty table means take all.

    For a table that cannot be read, pass None with a session active: the cutoff is then now less the overlap.
    """
    back = F.expr(f"INTERVAL {overlap}")
    if conversations is None:
        from pyspark.sql import SparkSession

        return SparkSession.active().range(1).select((instant_of(as_of) - back).alias("cutoff_ts"))
    return conversations.agg(F.max("harvested_at").alias("_newest")).select(
        (F.col("_newest") - back).alias("cutoff_ts")
    )


def incremental_filter(df: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Rows updated since the cutoff, rows without an update time, and all rows where there is no cutoff.

    The cutoff is a scalar subquery, so it is also used to skip row groups of the scan.
    """
    return df.where(updated_since(cutoff))


def updated_since(cutoff: DataFrame) -> Column:
    """The condition of `incremental_filter`; never null."""
    since = F.coalesce(cutoff.select("cutoff_ts").scalar(), F.lit("0001-01-01").cast("timestamp"))
    updated = F.col("last_updated_ts")
    return updated.isNull() | (updated >= since)
