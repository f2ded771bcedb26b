"""Keyed merges as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.operators.ranking import top_k


def newest_rows(source: DataFrame, keys: list[str], order: list[Column], null_is_key: bool = False) -> DataFrame:
    """The first row of every key in the given order.

    Rows that lack a part of the key have no key to be equal in: all of them stay, as a keyed merge keeps them.
    With `null_is_key`, a missing part is a value like others.
    """
    if null_is_key:
        return top_k(source, keys, order, 1, "_rk").drop("_rk")
    lacking = F.lit(False)
    for key in keys:
        lacking = lacking | F.col(key).isNull()
    # A row without a full key is a group of its own, so that such rows don't gather in one task either.
    apart = source.withColumn("_apart", F.when(lacking, F.monotonically_increasing_id()))
    return top_k(apart, [*keys, "_apart"], order, 1, "_rk").drop("_rk", "_apart")


def latest_per_key(
    source: DataFrame, keys: list[str], order_by: str | None = "harvested_at", null_is_key: bool = False
) -> DataFrame:
    """One row per key: the newest, and among equals the one whose values sort last. See newest_rows for missing keys.

    `incomplete_keys` counts the rows that lack a part of the key.
    """
    return newest_rows(source, keys, newest_first(source, keys, order_by), null_is_key)


def newest_first(source: DataFrame, keys: list[str], order_by: str | None, *then: Column) -> list[Column]:
    """The order of the rows of a key: newest first, among equals by `then`, and at last by the hash of their values."""
    rest = [c for c in source.columns if c not in keys and c != order_by]
    newest = [F.col(order_by).desc_nulls_last()] if order_by else []
    return [*newest, *then, F.xxhash64(*rest).desc() if rest else F.lit(0).asc()]


def incomplete_keys(source: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows lack which part of the key."""
    return source.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(k).isNull()).alias(f"no_{k}") for k in keys])


def upsert(
    target: DataFrame, source: DataFrame, keys: list[str], order_by: str = "harvested_at",
    cols: list[str] | None = None,
) -> DataFrame:
    """Target with source merged in by key: matches are updated, the rest of source is added.

    With `cols`, a match takes only these columns from source and keeps its others; an added row is
    null in the columns source does not bring.
    """
    newest = latest_per_key(source, keys, order_by)
    if cols is None:
        return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*target.columns))
    marked = newest.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    merged = target.join(marked, keys, "full_outer")
    taken = {c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in cols}
    return merged.withColumns(taken).select(*target.columns)


def snapshot_upsert(target: DataFrame, daily: DataFrame) -> DataFrame:
    """Scores kept per day and space, with a day's new values merged in as a whole set."""
    keys = ["snapshot_date", "space_id"]
    cols = ["title", "score", "grade", "accuracy_pct", "error_pct", "msgs", "users", "days_since_active",
            "benchmark_ran", "updated_at"]
    return upsert(target, daily, keys, "updated_at", cols)
