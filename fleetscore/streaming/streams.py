"""Streams of messages: into the message table, and into daily and per-conversation figures.

Figures are computed from the stored messages, so nothing is dropped as late and a newer version of a message isn't
counted beside the older one. A batch delivered again changes nothing, except that messages without a full key
are added again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetscore.functions.columns import NEGATIVE, POSITIVE, is_error, tally
from fleetscore.operators.ranking import same_keys
from fleetscore.schemas import PRIMARY_KEYS
from fleetscore.sources import versions
from fleetscore.sources.bronze import merge_partitions, publish_partitions, read_merged
from fleetscore.sources.payloads import conversation_rollup

MESSAGE_KEYS = PRIMARY_KEYS["message_details"]
CONVERSATION_KEYS = PRIMARY_KEYS["conversations"]


def _run(df: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode("append").foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _ingested(
    stream: DataFrame, path: str, checkpoint: str, flatten: Callable[[DataFrame], DataFrame] | None,
    then: Callable[[DataFrame, list], None] | None = None,
) -> StreamingQuery:
    """Merge every batch into the message table at `path`, and hand its messages and days on."""

    def merge(batch: DataFrame, _: int) -> None:
        messages = flatten(batch) if flatten else batch
        dated = messages.withColumn("created_date", F.to_date("created_ts")).persist()
        if not dated.isEmpty():
            days = merge_partitions(dated, path, MESSAGE_KEYS)
            if then:
                then(dated, days)
        dated.unpersist()

    return _run(stream, merge, checkpoint)


def stream_ingest_messages(
    stream: DataFrame, path: str, checkpoint: str, flatten: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Keep a message table up to date. Newer versions of a message replace older ones, whatever the
    order they come in, so no row is dropped as a repeat or as late.

    `flatten` makes messages of a batch, as payloads.flatten_messages does of landed documents.
    """
    return _ingested(stream, path, checkpoint, flatten)


def stream_daily_trend(
    stream: DataFrame, messages_path: str, path: str, checkpoint: str,
    flatten: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Messages, users, failures and ratings per space and day: the days a batch touches are counted anew."""

    def count(batch: DataFrame, days: list) -> None:
        dated = [day for day in days if day is not None]
        stored = read_merged(batch.sparkSession, messages_path, batch.schema, "created_date", dated)
        publish_partitions(stored.groupBy("space_id", F.col("created_date").alias("date")).agg(
            F.count("*").alias("messages"), F.countDistinct("user_id").alias("users"), tally(is_error()).alias("errors"),
            tally(F.col("feedback_rating") == POSITIVE).alias("feedback_pos"),
            tally(F.col("feedback_rating") == NEGATIVE).alias("feedback_neg"),
            F.count("feedback_rating").alias("rated"),
        ), path, "date", dated)

    return _ingested(stream, messages_path, checkpoint, flatten, count)


def stream_conversation_rollup(
    stream: DataFrame, messages_path: str, rollup_path: str, checkpoint: str, buckets: int = 64,
    flatten: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Ingest messages and roll up anew the conversations a batch touches.

    The table is kept in buckets of conversations, so that a batch writes only those it touches.
    """
    bucket = F.pmod(F.xxhash64(*CONVERSATION_KEYS), F.lit(buckets)).cast("int")

    def roll(batch: DataFrame, _: list) -> None:
        spark = batch.sparkSession
        touched = batch.select(*CONVERSATION_KEYS).distinct()
        stored = _stored_since(spark, messages_path, batch, _earliest_day(spark, batch, touched, rollup_path))
        rollup = conversation_rollup(same_keys(stored, touched, CONVERSATION_KEYS, "left_semi"))
        merge_partitions(rollup.withColumn("bucket", bucket), rollup_path, CONVERSATION_KEYS, "bucket", None, True)

    return _ingested(stream, messages_path, checkpoint, flatten, roll)


def _stored_since(spark: SparkSession, path: str, batch: DataFrame, day) -> DataFrame:
    """The stored messages from a day on, and those without a day; older folders aren't listed."""
    state = versions.published(spark, path)
    first = None if day is None else versions.folder_of("created_date", day)
    undated = versions.folder_of("created_date", None)
    folders = [f for f in state.partitions if first is None or f == undated or f >= first]
    return versions.read(spark, path, state, batch.schema, folders)


def _earliest_day(spark: SparkSession, batch: DataFrame, touched: DataFrame, rollup_path: str):
    """The first day that can hold messages of the touched conversations; one value, to prune the scan."""
    schema = conversation_rollup(batch).withColumn("bucket", F.lit(0)).schema
    known = same_keys(read_merged(spark, rollup_path, schema), touched, CONVERSATION_KEYS, "left_semi")
    days = [batch.agg(F.min("created_date")).first()[0], known.agg(F.min(F.to_date("first_message_ts"))).first()[0]]
    return min((d for d in days if d is not None), default=None)
