"""Places and running sums inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetscore.llm.arrays import settle

_BITS = 33  # monotonically_increasing_id: task number above, row number within the task below


def running(df: DataFrame, group: list[str], order: list[Column], place: str, sums: dict[str, str], purpose: str) -> DataFrame:
    """df with `place`, the number of rows of its group before a row, and for each `out: column` of `sums` their sum.

    The rows are range-sorted on group and order together, so a large group is spread over many tasks; what a row has
    before it is what its own task holds of the group plus the group's totals of the tasks before. The sorted rows are
    written, so a task run again can't number them differently. Group columns hold no nulls; `order` should decide
    every pair of rows that differ.
    """
    placed = settle(
        df.sort(*group, *order).withColumn("_place", F.monotonically_increasing_id()), purpose
    ).withColumn("_task", F.shiftright("_place", _BITS))
    keys = [*group, "_task"]
    totals = placed.groupBy(*keys).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(f"_t_{out}").over(earlier).alias(f"_b_{out}") for out in sums])
    inside = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({f"_i_{out}": F.sum(c).over(inside) for out, c in sums.items()}).join(before, keys)
    zero = F.lit(0)
    return out.withColumns({
        place: F.col("_before") + F.col("_place") - F.col("_first"),
        **{name: F.coalesce(f"_b_{name}", zero) + F.coalesce(f"_i_{name}", zero) for name in sums},
    }).select(*df.columns, place, *sums)


def quantiles(df: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, value): the least value that `share` of the group's rows don't exceed, exactly, for groups of any size."""
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    placed = running(df.select(group, value), [group], [F.col(value).asc()], "_at", {}, "quantiles")
    return placed.join(counts, group).where(F.col("_at") == F.ceil(F.lit(share) * F.col("_n")) - 1).select(group, value)
