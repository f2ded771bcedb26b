"""Ranks inside groups of any size.

A row_number window sends each whole group to one task, so one busy space would hold up a fleet.
Here the rows are range-sorted on the group and the order together, which splits a large group over
many tasks; a rank is then the row's place in its task plus the group's rows in the tasks before.
Top-k questions do not need this: Spark keeps only k rows per group and task ahead of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetscore.session import ensure_checkpoint_dir, with_known_size

_BITS = 33  # monotonically_increasing_id: task number above, row number within the task below


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet, keeping the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def ordered_rank(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Add `out`, the 1-based place of a row in its group (in the whole input when group is empty).

    `order` should decide every pair of rows. The sorted rows are checkpointed, so that a task run
    again after a lost executor cannot number them differently.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.sort(*[F.col(g).asc_nulls_first() for g in group], *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_task", F.shiftright("_place", _BITS))
    )
    # One row per task and group met there: at most tasks + groups rows, whatever the group sizes.
    stretches = placed.groupBy(*group, "_task").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n")
    )
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = stretches.select(
        *group, "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return (
        same_keys(placed, offsets, [*group, "_task"])
        .withColumn(out, rank.cast("int"))
        .drop("_place", "_task", "_first", "_before")
    )


def running(df: DataFrame, group: list[str], order: list[Column], place: str, sums: dict[str, str]) -> DataFrame:
    """df with `place`, the number of rows of its group before a row, and for each `out: column` of `sums` their sum.

    As `ordered_rank`: sorted over tasks, what a row has before it is what its own task holds of the group, plus the
    group's totals of the tasks before.
    """
    placed = with_known_size(
        df.sort(*[F.col(g).asc_nulls_first() for g in group], *order).withColumn("_place", F.monotonically_increasing_id()), "running"
    ).withColumn("_task", F.shiftright("_place", _BITS))
    keys = [*group, "_task"]
    totals = placed.groupBy(*keys).agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()]
    )
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        *[F.sum(f"_t_{out}").over(earlier).alias(f"_b_{out}") for out in sums],
    )
    inside = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumns({f"_i_{out}": F.sum(c).over(inside) for out, c in sums.items()})
    zero = F.lit(0)
    return same_keys(own, before, keys).withColumns({
        place: F.col("_before") + F.col("_place") - F.col("_first"),
        **{out: F.coalesce(f"_b_{out}", zero) + F.coalesce(f"_i_{out}", zero) for out in sums},
    }).select(*df.columns, place, *sums)


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rk") -> DataFrame:
    """The k first rows of every group with their place; k is the size of the report."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, place).where(F.col(out) <= k)
