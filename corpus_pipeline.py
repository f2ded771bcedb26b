"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, source mixing.

Each stage works on all rows its predecessor kept and returns a DataFrame; all but the last return the columns of
their input. `run` writes every stage as Parquet to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.llm import curriculum, decontaminate, langid, line_spread, neardup
from fleetscore.llm.arrays import settle, text_key


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models learn from the labelled documents that aren't held out."""
    models = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    t1, t2 = text_key(F.col("text"))
    keyed = docs.withColumns({"_t1": t1, "_t2": t2})
    # Few texts are rejected: they are the side that moves.
    rejected = langid.decisions(keyed.select("_t1", "_t2", "text"), models).where("not accepted").select("_t1", "_t2").distinct()
    return keyed.join(settle(rejected, "rejected"), ["_t1", "_t2"], "left_anti").select(*docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; those with nothing else are gone."""
    return line_spread.remove_shared_lines(docs).where("not emptied").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The one with the least doc_id stays, one without id only in a group that has none else; equal ids go by the text.
    Rows equal in doc_id and text are one document. Empty texts are in no group.
    """
    gone = neardup.representatives(neardup.classes(docs, shingle=5, share=(80, 100), bands=51, rows=5))
    name = F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("-")).alias("_d")
    t1, t2 = text_key(F.col("text"))
    rest = docs.withColumns({"_d": name, "_t1": t1, "_t2": t2})
    rest = rest.join(gone.select(name, F.col("t1").alias("_t1"), F.col("t2").alias("_t2")), ["_d", "_t1", "_t2"], "left_anti")
    return rest.dropDuplicates(["_d", "_t1", "_t2"]).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.benchmark_hits(docs, items, "_hits").where(F.size("_hits") == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per take, in order of training position, with position and taken (words of this take)."""
    return curriculum.training_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("line_dedup", without_shared_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: Language models, near-duplicate candidates and edit distances aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
