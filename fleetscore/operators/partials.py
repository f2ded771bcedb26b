"""Activity figures from states kept per space and day, which merge into the figures of any span.

The state of a day is sums, a count per tenth of a second of latency (from which the exact p90 of any union follows), and
the set of its users (from which exact distinct users follow). A day whose messages change is computed anew, no other.
Rows without a time belong to the day null: they count in figures of a space, not in series. Null spaces and users are
handled as in `factors` and `trends`, whose results these equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetscore.functions.columns import NEGATIVE, POSITIVE, date_of, is_error, percent, tally
from fleetscore.operators.factors import feedback_flags
from fleetscore.operators.ranking import same_keys

DAY = "created_date"
MESSAGE_STATES = ("sums", "latency", "users", "flags")
STATES = (*MESSAGE_STATES, "conversations")


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.to_date("created_ts"))


def message_states(messages: DataFrame) -> dict[str, DataFrame]:
    """The states of all days in messages, by name."""
    dated, keys = _dated(messages), ["space_id", DAY]
    return {
        "sums": dated.groupBy(*keys).agg(
            F.count("*").alias("msgs"), tally(is_error()).alias("errors"),
            tally(F.col("feedback_rating") == POSITIVE).alias("thumbs_up"),
            tally(F.col("feedback_rating") == NEGATIVE).alias("thumbs_down"), F.count("feedback_rating").alias("rated"),
            F.max("created_ts").alias("last_created_ts")),
        "latency": dated.where("response_time_sec is not null").groupBy(
            *keys, F.round("response_time_sec", 1).alias("seconds")).agg(F.count("*").alias("n")),
        "users": dated.where("user_id is not null").select(*keys, "user_id").distinct(),
        "flags": feedback_flags(messages).withColumn(DAY, F.to_date("created_ts")),
    }


def conversation_states(conversations: DataFrame) -> DataFrame:
    return _dated(conversations).groupBy("space_id", DAY).agg(
        F.count("*").alias("convos"), F.count("message_count").alias("counted"), F.sum("message_count").alias("messages"))


def merged_stats(states: dict[str, DataFrame], keys: list[str | Column]) -> DataFrame:
    """What factors.message_stats has per key, from states; keys are columns of (space_id, created_date)."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    by = lambda name: states[name].select(*columns, *[c for c in states[name].columns if c not in ("space_id", DAY)])
    names = by("sums").columns[: len(columns)]
    sums = by("sums").groupBy(*names).agg(
        *[F.sum(c).alias(c) for c in ("msgs", "errors", "thumbs_up", "thumbs_down", "rated")],
        F.max("last_created_ts").alias("last_created_ts"))
    users = by("users").groupBy(*names).agg(F.countDistinct("user_id").alias("users"))
    # A key has as many rows here as it has different tenths of a second.
    tenths = by("latency").groupBy(*names, "seconds").agg(F.sum("n").alias("n"))
    upwards = Window.partitionBy(*names).orderBy("seconds")
    whole = Window.partitionBy(*names)
    reached = tenths.select(*names, "seconds", F.sum("n").over(upwards).alias("upto"), F.sum("n").over(whole).alias("total"))
    p90 = reached.where("10 * upto >= 9 * total").groupBy(*names).agg(F.min("seconds").alias("p90_latency_s"))
    joined = same_keys(same_keys(sums, users, names, "left"), p90, names, "left").na.fill(0, ["users"])
    return joined.withColumn("error_pct", percent(F.col("errors"), F.col("msgs"))).withColumn(
        "feedback_coverage_pct", percent(F.col("rated"), F.col("msgs")))


def factors_of(states: dict[str, DataFrame], as_of=None) -> DataFrame:
    """operators.factors.factors."""
    return merged_stats(states, ["space_id"]).select(
        "space_id", "msgs", "users", "error_pct", "p90_latency_s", "thumbs_up", "thumbs_down", "feedback_coverage_pct",
        F.datediff(date_of(as_of), F.col("last_created_ts").cast("date")).alias("days_since_active"))


def daily_trends_of(states: dict[str, DataFrame]) -> DataFrame:
    """operators.trends.daily_trends."""
    dated = {name: df.where(F.col(DAY).isNotNull()) for name, df in states.items()}
    by_message = merged_stats(dated, ["space_id", F.col(DAY).alias("date")]).select(
        "space_id", "date", F.col("msgs").alias("messages"), "users", F.col("error_pct").alias("error_rate"),
        F.col("thumbs_up").alias("feedback_pos"), F.col("thumbs_down").alias("feedback_neg"),
        F.col("feedback_coverage_pct").alias("feedback_cov"), F.col("p90_latency_s").alias("p90_latency"))
    by_conversation = dated["conversations"].select("space_id", F.col(DAY).alias("date"), F.col("convos").alias("conversations"))
    return by_message.join(by_conversation, ["space_id", "date"], "full_outer").na.fill(
        0, ["conversations", "messages", "users"]).select(
        "space_id", "date", "conversations", "messages", "users", "error_rate", "feedback_pos", "feedback_neg", "feedback_cov",
        "p90_latency")


def _weeks(states: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list]:
    dated = {name: df.where(F.col(DAY).isNotNull()) for name, df in states.items()}
    return dated, [F.date_trunc("WEEK", F.col(DAY).cast("timestamp")).alias("wk"), "space_id"]


def weekly_of(states: dict[str, DataFrame]) -> DataFrame:
    """trend_users, trend_feedback, trend_quality and trend_conversations (operators.trends) side by side, per week and space."""
    dated, keys = _weeks(states)
    stats = merged_stats(dated, keys).select(
        "wk", "space_id", "msgs", "users", "error_pct", F.col("p90_latency_s").alias("p90_s"), F.col("thumbs_up").alias("pos"),
        F.col("thumbs_down").alias("neg"), "rated")
    convos = dated["conversations"].groupBy(*keys).agg(F.sum("convos").alias("conversations"))
    return stats.join(convos, ["wk", "space_id"], "full_outer")


def depth_of(states: dict[str, DataFrame]) -> DataFrame:
    """operators.trends.trend_depth."""
    return states["conversations"].groupBy("space_id").agg(
        F.round(F.sum("messages") / F.when(F.sum("counted") > 0, F.sum("counted")), 2).alias("avg_msgs_per_convo"),
        F.sum("convos").alias("convos"))
