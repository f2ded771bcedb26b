"""Weekly and daily series and the detail lists of a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import NEGATIVE, POSITIVE, is_error, tally
from fleetscore.operators.factors import message_stats
from fleetscore.operators.incremental import scope_by_ids
from fleetscore.operators.ranking import top_k


def _weekly(df: DataFrame, ids) -> DataFrame:
    scoped = df if ids is None else scope_by_ids(df, ids)
    return scoped.where(F.col("created_ts").isNotNull()).withColumn("wk", F.date_trunc("WEEK", "created_ts"))


def trend_conversations(conversations: DataFrame, ids=None) -> DataFrame:
    return _weekly(conversations, ids).groupBy("wk", "space_id").agg(F.count("*").alias("n"))


def trend_users(messages: DataFrame, ids=None) -> DataFrame:
    return _weekly(messages, ids).groupBy("wk", "space_id").agg(F.countDistinct("user_id").alias("n"))


def trend_feedback(messages: DataFrame, ids=None) -> DataFrame:
    rating = F.col("feedback_rating")
    return _weekly(messages, ids).groupBy("wk", "space_id").agg(
        tally(rating == POSITIVE).alias("pos"),
        tally(rating == NEGATIVE).alias("neg"),
        F.count(rating).alias("rated"),
    )


def trend_quality(messages: DataFrame, ids=None) -> DataFrame:
    stats = message_stats(_weekly(messages, ids), ["wk", "space_id"])
    return stats.select("wk", "space_id", "error_pct", F.col("p90_latency_s").alias("p90_s"), "msgs")


def trend_depth(conversations: DataFrame) -> DataFrame:
    """Messages per conversation: how deep people go."""
    return conversations.groupBy("space_id").agg(
        F.round(F.avg("message_count"), 2).alias("avg_msgs_per_convo"), F.count("*").alias("convos")
    )


def daily_trends(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per space and day with messages or conversations; counts are 0 and rates null on a gap."""
    day = F.col("created_ts").cast("date").alias("date")
    dated = messages.where(F.col("created_ts").isNotNull()).select("*", day)
    by_message = message_stats(dated, ["space_id", "date"]).select(
        "space_id", "date", F.col("msgs").alias("messages"), "users", F.col("error_pct").alias("error_rate"),
        F.col("thumbs_up").alias("feedback_pos"), F.col("thumbs_down").alias("feedback_neg"),
        F.col("feedback_coverage_pct").alias("feedback_cov"), F.col("p90_latency_s").alias("p90_latency"),
    )
    by_conversation = (
        conversations.where(F.col("created_ts").isNotNull())
        .groupBy("space_id", day)
        .agg(F.count("*").alias("conversations"))
    )
    return (
        by_message.join(by_conversation, ["space_id", "date"], "full_outer")
        .na.fill(0, ["conversations", "messages", "users"])
        .select("space_id", "date", "conversations", "messages", "users", "error_rate", "feedback_pos",
                "feedback_neg", "feedback_cov", "p90_latency")
    )


def top_questions(messages: DataFrame, k: int = 8) -> DataFrame:
    """The k questions asked most in every space; newer ones first among equals."""
    asked = (
        messages.where(F.col("user_question").isNotNull())
        .groupBy("space_id", F.col("user_question").alias("question"))
        .agg(F.count("*").alias("asked"), F.max("created_ts").alias("last_asked"))
    )
    order = [F.col("asked").desc(), F.col("last_asked").desc_nulls_last(), F.col("question").asc()]
    return top_k(asked, ["space_id"], order, k)


def _newest_first() -> list[Column]:
    return [F.col("created_ts").desc_nulls_last(), F.col("message_id").asc()]


def recent_errors(messages: DataFrame, k: int = 6) -> DataFrame:
    """The k newest failures of every space."""
    failed = messages.where(is_error()).select(
        "space_id", "message_id", "created_ts", "user_question", "error_type", "error_message"
    )
    return top_k(failed, ["space_id"], _newest_first(), k)


def feedback_samples(messages: DataFrame, k: int = 6) -> DataFrame:
    """The k newest rated messages of every space."""
    rated = messages.where(F.col("feedback_rating").isNotNull()).select(
        "space_id", "message_id", "created_ts", "user_question", "feedback_rating"
    )
    return top_k(rated, ["space_id"], _newest_first(), k)


def score_history(snapshots: DataFrame, ids=None) -> DataFrame:
    """Kept scores by day."""
    scoped = snapshots if ids is None else scope_by_ids(snapshots, ids)
    return scoped.select("snapshot_date", "space_id", "title", "score", "grade", "accuracy_pct").orderBy(
        "snapshot_date"
    )


def flagged_by_space(flags: DataFrame, space_id: str) -> DataFrame:
    """The flagged questions of one space, newest first."""
    return (
        flags.where(F.col("space_id") == space_id)
        .select("question", "sql_generated", "error_type", "created_ts")
        .orderBy(F.col("created_ts").desc_nulls_last())
    )
