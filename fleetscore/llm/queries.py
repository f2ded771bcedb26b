"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.llm import (
    curriculum, decontaminate, langid, line_spread, merkle, neardup, perplexity, prefix_join, toolcalls, topk, trie, warc, wordpiece)
from fleetscore.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.get("takes", F.lit(0))["position"].alias("position"), F.get("takes", F.lit(1))["position"].alias("second_position"),
    ).sort(F.col("position").asc_nulls_last(), "doc_id")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_shared_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "emptied", "text")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and each benchmark item that it holds."""
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = toolcalls.events_of_conversations(_table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame([("answer", toolcalls.ANSWER_SCHEMA)], "name string, schema string")
    return toolcalls.linked(events, schemas)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


def quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return topk.nearest(vectors, topk.sampled_queries(vectors))


def arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    arcs = pages.mapInArrow(warc.pages_to_arc, "path string, content binary")
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.to_warc(arcs), path)
    return warc.resolved(warc.read_warc(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id")


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(_table(spark, sf_dir, "documents"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, lengths = trie.with_shared_openings(trie.turns(_table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(placed, lengths)


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_tool_call_linking": tool_call_linking,
        "op2_language_id": language_id,
        "op3_curriculum_mix": curriculum_mix,
        "op4_token_counts": token_counts,
        "op5_line_dedup": line_dedup,
        "op6_decontamination": decontamination,
        "op7_quality_perplexity": quality_perplexity,
        "op8_exact_topk": exact_topk,
        "op9_near_dedup": near_dedup,
        "op10_arc_to_warc": arc_to_warc,
        "op11_merkle_manifest": merkle_manifest,
        "op12_prefix_trie": prefix_trie,
        "op13_ngram_jaccard_join": ngram_jaccard_join,
    }
