"""Checks that report and never drop rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fleetscore.functions.columns import tally

HAS_SPACE_ID = {"has_space_id": "space_id IS NOT NULL"}


def expectation_report(df: DataFrame, expectations: dict[str, str], table_name: str) -> DataFrame:
    """One row per expectation with the rows that meet it and the rows that do not; one pass over the table."""
    met = [F.coalesce(tally(F.expr(rule)), F.lit(0)).alias(f"_{i}") for i, rule in enumerate(expectations.values())]
    counted = df.agg(F.count("*").alias("_all"), *met)
    rows = F.array(*[
        F.struct(F.lit(name).alias("expectation"), F.col(f"_{i}").alias("passed"))
        for i, name in enumerate(expectations)
    ])
    return counted.select("_all", F.explode(rows).alias("r")).select(
        F.lit(table_name).alias("table_name"), "r.expectation", "r.passed",
        (F.col("_all") - F.col("r.passed")).alias("failed"),
    )


def observe_expectations(df: DataFrame, expectations: dict[str, str], name: str) -> tuple[DataFrame, Observation]:
    """The same counts gathered while the table is used for something else."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows"),
                      *[tally(F.expr(rule)).alias(k) for k, rule in expectations.items()]), watch


def key_violations(df: DataFrame, pk: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*pk).agg(F.count("*").alias("n")).where(F.col("n") > 1)
