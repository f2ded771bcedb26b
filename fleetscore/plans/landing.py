"""The landing plan: files of JSON documents to bronze tables, and on to the daily run.

A landing reads the files the ledger doesn't know (see `sources.ledger`). Conversations, messages and spaces are merged by key,
so a document may be landed any number of times. Curation, runs and results are listed whole per space by a harvest and replace
what is stored of that space. Tables are kept by day of creation or by bucket of spaces; only those touched are written,
and readers see each table before or after.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetscore import schemas
from fleetscore.operators import partials
from fleetscore.operators.incremental import incremental_cutoff, scope, updated_since
from fleetscore.operators.ranking import same_keys
from fleetscore.plans.daily import run_daily
from fleetscore.session import stored_meanwhile
from fleetscore.sources import ledger, payloads, versions
from fleetscore.sources.bronze import merge_partitions, publish_partitions, read_merged

_KEYS = schemas.PRIMARY_KEYS["conversations"]
_DATED = ("conversations", "message_details")


BUCKETS = 64  # of spaces, in tables that have no day


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("created_date", F.to_date("created_ts"))


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("space_id"), F.lit(BUCKETS)).cast("int"))


def _schema(spark: SparkSession, table: str) -> StructType:
    empty = spark.createDataFrame([], schemas.BRONZE[table])
    return (_dated(empty) if table in _DATED else _bucketed(empty)).schema


def land_conversations(
    spark: SparkSession, raw: DataFrame, base: str, harvested_at=None, ids=None, overlap: str = "2 hours"
) -> dict[str, list]:
    """Conversations in scope that changed since the last harvest, with all their landed messages; returns the days touched.

    Conversations that were never updated are always taken. An empty landing changes nothing.
    Documents are parsed once and stored as rows until both tables are merged; a message whose own page shows a changed conversation is taken as it stands, so
    only messages on other pages are looked up.
    """
    stored = read_merged(spark, f"{base}/conversations", _schema(spark, "conversations"))
    changed = F.col("_first") & updated_since(incremental_cutoff(stored, overlap=overlap))
    pages = scope(payloads.flatten_pages(raw, harvested_at), ids).withColumn("_changed", changed)
    days = {}
    with stored_meanwhile(pages, "pages") as pages:
        fresh = payloads.conversations_of(pages.where("_changed"))
        messages = payloads.messages_of(pages.where("_changed"))
        others = payloads.messages_of(pages.where("not _changed"))
        if not others.isEmpty():
            messages = messages.unionByName(same_keys(others, fresh.select(*_KEYS).distinct(), _KEYS, "left_semi"))
        messages = _dated(messages)
        days["message_details"] = merge_partitions(messages, f"{base}/message_details", schemas.PRIMARY_KEYS["message_details"], stored=True)
        whole = payloads.with_empty_conversations(fresh, payloads.conversation_rollup(messages), harvested_at)
        days["conversations"] = merge_partitions(_dated(whole), f"{base}/conversations", _KEYS)
    return days


def replace_spaces(rows: DataFrame, spaces: DataFrame, path: str) -> None:
    """Put `rows` in the place of all stored rows of `spaces`; of a space that is listed without rows, nothing stays."""
    spark = rows.sparkSession
    listed = _bucketed(spaces.select("space_id").distinct()).persist()
    touched = [r[0] for r in listed.select("bucket").distinct().collect()]
    fresh = _bucketed(rows)

    def replaced(state: versions.State) -> DataFrame:
        stored = versions.read(spark, path, state, fresh.schema, [versions.folder_of("bucket", b) for b in touched])
        return same_keys(stored, listed.select("space_id"), ["space_id"], "left_anti").unionByName(fresh)

    if touched:
        versions.publish(spark, path, "bucket", replaced, touched)
    listed.unpersist()


def land(spark: SparkSession, landed: str, base: str, harvested_at=None, ids=None, prefix: str | None = None) -> dict[str, list]:
    """One harvest, a folder of JSON lines per kind of document under `landed`, into the bronze tables under `base`.

    Spaces named by `ids`, else those whose folder starts with `prefix`, else all. Returns the days touched by table.
    Files of two kinds that belong together (results and their details) come in one landing.
    """
    books, dead = f"{base}/ledger", f"{base}/quarantine"
    kinds = ("spaces", "space_details", "space_meta", "instructions", "curated_questions", "eval_runs", "eval_results",
             "eval_result_details", "conversations")
    files = {kind: ledger.new_files(spark, f"{landed}/{kind}", kind, books) for kind in kinds}
    lines = {kind: ledger.read_files(spark, files[kind]) for kind in kinds}
    good = {kind: ledger.readable(lines[kind]).select("payload") for kind in kinds}

    spaces = scope(payloads.flatten_spaces(good["spaces"], good["space_details"], harvested_at), ids, prefix)
    merge_partitions(_bucketed(spaces), f"{base}/spaces", schemas.PRIMARY_KEYS["spaces"], "bucket")
    inside = read_merged(spark, f"{base}/spaces", _schema(spark, "spaces")).select("space_id")
    flat = {
        "space_meta": payloads.flatten_space_meta(good["space_meta"]),
        "instructions": payloads.flatten_instructions(good["instructions"]),
        "curated_questions": payloads.flatten_curated_questions(good["curated_questions"]),
        "eval_runs": payloads.flatten_eval_runs(good["eval_runs"]),
        "eval_results": payloads.flatten_eval_results(good["eval_results"], good["eval_result_details"]),
    }
    for name, rows in flat.items():
        replace_spaces(scope(rows, inside), scope(payloads.spaces_of(good[name]), inside), f"{base}/{name}")
    days = land_conversations(spark, good["conversations"], base, harvested_at, inside)
    for kind in kinds:
        ledger.quarantine(lines[kind], files[kind], dead)
        ledger.enter(files[kind], books)
    return days


def bronze_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The bronze tables of a folder that `land` fills."""
    names = [name for name in schemas.BRONZE if name not in ("snapshots", "warehouses")]
    tables = {name: read_merged(spark, f"{base}/{name}", _schema(spark, name)) for name in names}
    return {name: df if name in _DATED else df.drop("bucket") for name, df in tables.items()}


def refresh_states(spark: SparkSession, base: str, states: str, days: dict[str, list]) -> None:
    """Compute the day states of the touched days anew, from these days alone."""
    def touched(table: str) -> DataFrame:
        return read_merged(spark, f"{base}/{table}", _schema(spark, table), "created_date", days[table])

    if days["message_details"]:
        for name, df in partials.message_states(touched("message_details")).items():
            publish_partitions(df, f"{states}/{name}", partials.DAY, days["message_details"])
    if days["conversations"]:
        publish_partitions(partials.conversation_states(touched("conversations")), f"{states}/conversations", partials.DAY, days["conversations"])


def day_states(spark: SparkSession, states: str) -> dict[str, DataFrame]:
    empty = {name: spark.createDataFrame([], schemas.BRONZE[name]) for name in _DATED}
    kinds = partials.message_states(empty["message_details"]) | {"conversations": partials.conversation_states(empty["conversations"])}
    return {name: read_merged(spark, f"{states}/{name}", df.schema) for name, df in kinds.items()}


def run_landed(
    spark: SparkSession, landed: str, bronze: str, gold: str, as_of=None, ids=None, prefix: str | None = None,
    model: Callable[[str], str | None] | None = None,
) -> Mapping[str, DataFrame]:
    """The whole day: new documents to bronze, touched days to their states, and these to gold and diagnosis."""
    days = land(spark, landed, bronze, as_of, ids, prefix)
    refresh_states(spark, bronze, f"{gold}/states", days)
    return run_daily(spark, bronze_tables(spark, bronze), gold, as_of, model, day_states(spark, f"{gold}/states"))
