"""How well a space is curated: instructions, examples, benchmark questions, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import (
    ACCEPTED, BENCHMARK, SAMPLE_QUESTION, SQL_INSTRUCTION, TEXT_INSTRUCTION, date_of, epoch_ms_to_ts, tally,
)
from fleetscore.operators.ranking import ordered_rank


def not_deprecated(curated: DataFrame) -> DataFrame:
    return curated.where(~F.coalesce("is_deprecated", F.lit(False)))


def table_count() -> F.Column:
    return F.coalesce(F.size("table_identifiers"), F.lit(0)).alias("n_tables")


def richness_facts(instructions: DataFrame, curated: DataFrame, meta: DataFrame) -> DataFrame:
    """Curation counts of every space with an instruction or a live curated question; others have no row."""
    by_instruction = instructions.groupBy("space_id").agg(
        tally(F.col("instruction_type") == SQL_INSTRUCTION).alias("sql_instructions"),
        tally(F.col("instruction_type") == TEXT_INSTRUCTION).alias("text_instructions"),
        tally(F.col("instruction_status") == ACCEPTED).alias("accepted_instructions"),
    )
    by_question = not_deprecated(curated).groupBy("space_id").agg(
        tally(F.col("question_type") == SAMPLE_QUESTION).alias("sample_questions"),
        tally(F.col("question_type") == BENCHMARK).alias("benchmark_questions_defined"),
    )
    return (
        by_instruction.join(by_question, "space_id", "full_outer")
        .join(meta.select("space_id", table_count()), "space_id", "left")
        .na.fill(0)
    )


def config_freshness(meta: DataFrame, as_of=None) -> DataFrame:
    """Age in days of the last change to a space's configuration."""
    changed = epoch_ms_to_ts(F.col("last_updated_timestamp"))
    return meta.select("space_id", changed.alias("last_config")).withColumn(
        "config_age_days", F.datediff(date_of(as_of), F.col("last_config").cast("date"))
    )


def richness_score(scorecard: DataFrame) -> DataFrame:
    """Accepted instructions + examples + defined benchmark questions."""
    total = F.col("accepted_instructions") + F.col("sample_questions") + F.col("benchmark_questions_defined")
    return scorecard.select("space_id", total.cast("bigint").alias("richness_score"))


def ranked_examples(curated: DataFrame) -> DataFrame:
    """Live curated questions of each space in id order."""
    live = not_deprecated(curated).select(
        "space_id", "curated_question_id", "question_text", "answer_text", "eval_note"
    )
    question_id = F.col("curated_question_id")
    order = [question_id.try_cast("bigint").asc_nulls_last(), question_id.asc_nulls_last()]
    return ordered_rank(live, ["space_id"], order, "rk").select(
        "space_id", "rk", "curated_question_id", "question_text", "answer_text", "eval_note"
    )
