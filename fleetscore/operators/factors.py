"""Activity, quality and feedback per space, from message grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import NEGATIVE, POSITIVE, clipped, date_of, is_error, p90, percent, tally
from fleetscore.operators.ranking import same_keys


def message_stats(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, distinct users, ratings and the 90th latency percentile per key.

    Latency is its own aggregate: beside a distinct count, Spark would keep one percentile digest
    per key and user. Both branches read a few columns and combine before the shuffle; the distinct
    users of a busy key are spread over tasks by user.
    """
    counted = messages.groupBy(*keys).agg(
        F.count("*").alias("msgs"),
        F.countDistinct("user_id").alias("users"),
        tally(is_error()).alias("errors"),
        tally(F.col("feedback_rating") == POSITIVE).alias("thumbs_up"),
        tally(F.col("feedback_rating") == NEGATIVE).alias("thumbs_down"),
        F.count("feedback_rating").alias("rated"),
        F.max("created_ts").alias("last_created_ts"),
    )
    latency = messages.groupBy(*keys).agg(p90("response_time_sec").alias("p90_latency_s"))
    return (
        same_keys(counted, latency, keys)
        .withColumn("error_pct", percent(F.col("errors"), F.col("msgs")))
        .withColumn("feedback_coverage_pct", percent(F.col("rated"), F.col("msgs")))
    )


def factors(messages: DataFrame, as_of=None) -> DataFrame:
    """One row per space that has messages."""
    return message_stats(messages, ["space_id"]).select(
        "space_id", "msgs", "users", "error_pct", "p90_latency_s", "thumbs_up", "thumbs_down",
        "feedback_coverage_pct",
        F.datediff(date_of(as_of), F.col("last_created_ts").cast("date")).alias("days_since_active"),
    )


def error_messages(messages: DataFrame) -> DataFrame:
    """Messages that failed, are still in flight, or carry an error."""
    return messages.where(is_error())


def feedback_flags(messages: DataFrame, chars: int | None = None) -> DataFrame:
    """Messages users rated down, with the SQL that was generated for them (its first `chars` characters, if given)."""
    return messages.where(F.col("feedback_rating") == NEGATIVE).select(
        "space_id", "message_id", F.col("user_question").alias("question"),
        clipped("sql_generated", chars), "error_type", "created_ts",
    )


def harvest_freshness(messages: DataFrame, as_of=None) -> DataFrame:
    """Age in days of the newest harvest of each space."""
    return (
        messages.groupBy("space_id")
        .agg(F.max("harvested_at").alias("last_harvest"))
        .withColumn("harvest_age_days", F.datediff(date_of(as_of), F.col("last_harvest").cast("date")))
    )
