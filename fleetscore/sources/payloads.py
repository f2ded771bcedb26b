"""Landed JSON payloads to bronze rows.

Every function takes a DataFrame with one JSON document (or a list of them) per row in the column
`payload`; rows are independent, so parsing spreads over files and needs no shuffle except where two
payloads are joined. Documents are parsed by an outer explode: filters on their fields then stay above
it, where they would otherwise be moved below and parse every document a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore import schemas
from fleetscore.functions.columns import (
    clipped,
    COMPLETED, FAILED, blank_to_null, epoch_ms_to_ts, first_filled, instant_of, owner_from_path, run_recency, tally,
)
from fleetscore.operators.upsert import latest_per_key

_MESSAGE_COLUMNS = [c.split()[0] for c in schemas.BRONZE["message_details"].split(", ")]
_CONVERSATION_COLUMNS = [c.split()[0] for c in schemas.BRONZE["conversations"].split(", ")]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON lines; malformed lines come out as rows without an id."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    listed = "array<struct<" + ",".join(":".join(c.strip().split(" ", 1)) for c in _top_level(schema)) + ">>"
    return raw.select(F.explode_outer(F.from_json("payload", listed)).alias("p")).select("p.*")


def _top_level(schema: str) -> list[str]:
    """The columns of a schema text, cut at the commas outside of brackets."""
    cut, depth = [""], 0
    for ch in schema:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            cut.append("")
        else:
            cut[-1] += ch
    return cut


def _items(raw: DataFrame, schema: str, many: str) -> DataFrame:
    """The items of a landed list, each with the columns beside it."""
    page = _parsed(raw, schema)
    beside = [c for c in page.columns if c != many]
    return page.select(*beside, F.explode_outer(many).alias("i")).where(F.col("i").isNotNull())


def spaces_of(raw: DataFrame) -> DataFrame:
    """The spaces that documents are about, also those whose list is empty."""
    return _parsed(raw, "space_id string").where("space_id is not null").distinct()


def _int(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("int")


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("bigint")


def _any_set(struct: Column, *fields: str) -> Column:
    """Whether an object carries anything; {} counts as absent."""
    held = F.lit(False)
    for f in fields:
        held = held | struct.getField(f).isNotNull()
    return F.coalesce(held, F.lit(False))


# --- spaces -------------------------------------------------------------------------------------
def flatten_spaces(listed: DataFrame, detail: DataFrame, harvested_at=None) -> DataFrame:
    """A space as listed, with description, warehouse and folder from its detail where filled there."""
    full = _parsed(detail, schemas.SPACE_PAYLOAD).select(
        "space_id", *[F.col(c).alias(f"d_{c}") for c in ("description", "warehouse_id", "parent_path")]
    )
    return _parsed(listed, schemas.SPACE_PAYLOAD).join(full, "space_id", "left").select(
        "space_id", F.coalesce("title", F.lit("")).alias("title"),
        *[F.coalesce(blank_to_null(F.col(f"d_{c}")), c).alias(c)
          for c in ("description", "warehouse_id", "parent_path")],
        instant_of(harvested_at).alias("harvested_at"),
    )


def flatten_space_meta(raw: DataFrame) -> DataFrame:
    meta = _parsed(raw, schemas.SPACE_META_PAYLOAD)
    return meta.select(
        "space_id", "title", owner_from_path(F.col("parent_path")).alias("owner"), "parent_path", "warehouse_id",
        "run_as_type", _long("last_updated_timestamp").alias("last_updated_timestamp"),
        F.coalesce("table_identifiers", F.array().cast("array<string>")).alias("table_identifiers"),
    )


# --- conversations and messages -----------------------------------------------------------------
def _pages(raw: DataFrame) -> DataFrame:
    """Pages of conversations that have an id."""
    pages = _parsed(raw, schemas.CONVERSATION_PAYLOAD)
    conversation_id = first_filled(F.col("conversation.conversation_id"), F.col("conversation.id"))
    return pages.withColumn("conversation_id", conversation_id).where(F.col("conversation_id").isNotNull())


def flatten_conversations(raw: DataFrame) -> DataFrame:
    """Conversations with their ids and times, from the first page of each."""
    c = F.col("conversation")
    return _pages(raw).where(F.coalesce(_int("offset"), F.lit(0)) == 0).select(
        "space_id", "space_title", "conversation_id", c.title.alias("conversation_title"),
        _long(c.user_id).alias("user_id"), epoch_ms_to_ts(_long(c.created_timestamp)).alias("created_ts"),
        epoch_ms_to_ts(_long(c.last_updated_timestamp)).alias("last_updated_ts"),
    )


def _listed(raw: DataFrame, *beside: Column) -> DataFrame:
    """A row per place in the message list of a page; a page without messages has one row without place."""
    return _pages(raw).select(
        "space_id", "space_title", "conversation_id", F.col("conversation.title").alias("conversation_title"),
        F.coalesce(_int("offset"), F.lit(0)).alias("offset"), *beside, F.posexplode_outer("messages").alias("pos", "m"),
    )


def _with_attachments(listed: DataFrame) -> DataFrame:
    parsed = listed.withColumn("atts", F.from_json("m.attachments", schemas.ATTACHMENTS))
    return parsed.withColumns({
        "first_query": _first(_has_query), "first_text": _first(_has_text), "first_ask": _first(_has_suggestions),
    })


def exploded_messages(raw: DataFrame) -> DataFrame:
    """One row per message with its place in the conversation, its attachments and the first of each kind."""
    return _with_attachments(_listed(raw).where(F.col("m").isNotNull()))


def _message_id() -> Column:
    return first_filled(F.col("m.message_id"), F.col("m.id")).alias("message_id")


def _has_query(a: Column) -> Column:
    return _any_set(a.query, "id", "query", "title", "description", "statement_id", "last_updated_timestamp",
                    "parameters", "query_result_metadata")


def _has_text(a: Column) -> Column:
    return _any_set(a.text, "id", "content", "purpose")


def _has_suggestions(a: Column) -> Column:
    return _any_set(a.suggested_questions, "questions")


def _first(having) -> Column:
    return F.try_element_at(F.filter("atts", having), F.lit(1))


def _filled_json(c: Column) -> Column:
    """JSON text of a list or object that is not empty."""
    return F.when(~c.isin("", "[]", "{}", "null"), c)


def message_core() -> list[Column]:
    created, updated = _long("m.created_timestamp"), _long("m.last_updated_timestamp")
    both = (F.coalesce(created, F.lit(0)) != 0) & (F.coalesce(updated, F.lit(0)) != 0)
    return [
        _long("m.user_id").alias("user_id"), F.col("m.content").alias("user_question"),
        F.col("m.status").alias("status"), epoch_ms_to_ts(created).alias("created_ts"),
        epoch_ms_to_ts(updated).alias("completed_ts"),
        F.when(both, (updated - created) / F.lit(1000.0)).alias("response_time_sec"),
    ]


def first_query_columns() -> list[Column]:
    a = F.col("first_query")
    q = a.query
    return [
        q.query.alias("sql_generated"), q.title.alias("sql_title"), q.description.alias("sql_description"),
        F.coalesce(blank_to_null(a.attachment_id), q.id).alias("sql_attachment_id"),
        q.statement_id.alias("sql_statement_id"),
        epoch_ms_to_ts(_long(q.last_updated_timestamp)).alias("sql_last_updated_ts"),
    ]


def statement_ids_column() -> list[Column]:
    named = F.filter(F.transform("atts", lambda a: a.query.statement_id), lambda s: F.coalesce(s != "", F.lit(False)))
    return [F.when(F.size(named) > 0, F.to_json(named)).alias("sql_statement_ids")]


def query_parameters_column() -> list[Column]:
    return [_filled_json(F.col("first_query.query.parameters")).alias("sql_parameters")]


def query_result_columns() -> list[Column]:
    meta = F.col("first_query.query.query_result_metadata")
    return [_long(meta.row_count).alias("row_count"), meta.is_truncated.try_cast("boolean").alias("is_truncated")]


def legacy_result_columns() -> list[Column]:
    r = F.col("m.query_result")
    return [
        r.statement_id.alias("legacy_statement_id"), _long(r.row_count).alias("legacy_row_count"),
        r.is_truncated.try_cast("boolean").alias("legacy_is_truncated"),
    ]


def first_text_columns() -> list[Column]:
    a = F.col("first_text")
    return [
        a.text.content.alias("text_response"), a.text.purpose.alias("text_purpose"),
        F.coalesce(blank_to_null(a.attachment_id), a.text.id).alias("text_attachment_id"),
    ]


def suggestions_column() -> list[Column]:
    return [_filled_json(F.col("first_ask.suggested_questions.questions")).alias("suggested_questions")]


def _variant(raw: str, field: str) -> Column:
    return F.try_variant_get(F.try_parse_json(raw), f"$.{field}", "string")


def _present(raw: str) -> Column:
    """Whether a message has an object that is not empty, whatever its fields; the raw text is that of the document."""
    written = F.coalesce(F.to_json(F.try_parse_json(raw)), F.col(raw))
    return F.coalesce(~written.isin("", "{}", "[]", "null", "false", "0"), F.lit(False))


def error_feedback_columns() -> list[Column]:
    return [
        _variant("m.error", "type").alias("error_type"), _variant("m.error", "error").alias("error_message"),
        _variant("m.feedback", "rating").alias("feedback_rating"),
    ]


def presence_columns() -> list[Column]:
    """An error or feedback object counts by being there, also where it has none of the fields above."""
    return [_present("m.error").alias("has_error"), _present("m.feedback").alias("has_feedback")]


def attachment_columns() -> list[Column]:
    has = lambda first: F.col(first).isNotNull()
    return [
        F.coalesce(F.size("atts"), F.lit(0)).alias("attachment_count"),
        has("first_query").alias("has_query_attachment"), has("first_text").alias("has_text_attachment"),
        has("first_ask").alias("has_suggested_questions"),
        F.when(F.size("atts") > 0, F.col("m.attachments")).alias("raw_attachments_json"),
    ]


def position_columns() -> list[Column]:
    place = F.col("offset") + F.col("pos") + 1
    return [place.alias("message_position"), (place == 1).alias("is_first_message")]


_GROUPS = [
    message_core, first_query_columns, statement_ids_column, query_parameters_column, query_result_columns,
    legacy_result_columns, first_text_columns, suggestions_column, error_feedback_columns, attachment_columns,
    position_columns, presence_columns,
]


def message_columns(raw: DataFrame, *groups) -> DataFrame:
    """message_id and the columns of the given groups, e.g. message_columns(raw, first_text_columns)."""
    m = exploded_messages(raw)
    return m.select(_message_id(), *[c for g in groups for c in g()])


def flatten_messages(raw: DataFrame, harvested_at=None) -> DataFrame:
    """All columns of message_details."""
    return exploded_messages(raw).select(*_flat_columns(harvested_at)).select(*_MESSAGE_COLUMNS)


def _flat_columns(harvested_at) -> list[Column]:
    return [
        *map(F.col, ("space_id", "space_title", "conversation_id", "conversation_title")), _message_id(),
        *[c for g in _GROUPS for c in g()], instant_of(harvested_at).alias("harvested_at"),
    ]


def flatten_pages(raw: DataFrame, harvested_at=None) -> DataFrame:
    """Conversations and messages of pages that are parsed once; `conversations_of` and `messages_of` part them.

    The columns of message_details, and of the page: whether it is a conversation's first (`_first`), the conversation's own values,
    and whether a row stands for the page (`_page`) or for a message (`_message`), or for both.
    """
    c = F.col("conversation")
    listed = _listed(
        raw, _long(c.user_id).alias("_user_id"), epoch_ms_to_ts(_long(c.created_timestamp)).alias("_created_ts"),
        epoch_ms_to_ts(_long(c.last_updated_timestamp)).alias("last_updated_ts"),
    )
    kept = [(F.col("offset") == 0).alias("_first"), (F.coalesce("pos", F.lit(0)) == 0).alias("_page"),
            F.col("m").isNotNull().alias("_message"), *map(F.col, ("_user_id", "_created_ts", "last_updated_ts"))]
    return _with_attachments(listed).select(*_flat_columns(harvested_at), *kept)


def conversations_of(pages: DataFrame) -> DataFrame:
    """`flatten_conversations` of the documents that `flatten_pages` has parsed."""
    return pages.where("_first and _page").select(
        "space_id", "space_title", "conversation_id", "conversation_title", F.col("_user_id").alias("user_id"),
        F.col("_created_ts").alias("created_ts"), "last_updated_ts",
    )


def messages_of(pages: DataFrame) -> DataFrame:
    """`flatten_messages` of the documents that `flatten_pages` has parsed."""
    return pages.where("_message").select(*_MESSAGE_COLUMNS)


def conversation_rollup(messages: DataFrame) -> DataFrame:
    """Counts, time span and flags of every conversation, from its messages.

    A page may be landed more than once, as a harvest looks back; of each message the newest version counts.
    """
    used = ["space_id", "conversation_id", "message_id", "status", "created_ts", "has_query_attachment", "error_type",
            "error_message", "feedback_rating", "harvested_at", "has_error", "has_feedback"]
    # Tables from before these two columns go by the fields.
    messages = messages.withColumns({
        c: F.lit(None).cast("boolean") for c in ("has_error", "has_feedback") if c not in messages.columns})
    messages = latest_per_key(messages.select(*used), ["space_id", "conversation_id", "message_id"])
    failed = F.coalesce("has_error", F.lit(False)) | F.col("error_type").isNotNull() | F.col("error_message").isNotNull()
    rated = F.coalesce("has_feedback", F.lit(False)) | F.col("feedback_rating").isNotNull()
    return (
        messages.groupBy("space_id", "conversation_id")
        .agg(
            F.count("*").cast("int").alias("message_count"),
            tally(F.col("status") == COMPLETED).cast("int").alias("completed_count"),
            tally(F.col("status") == FAILED).cast("int").alias("failed_count"),
            F.min("created_ts").alias("first_message_ts"),
            F.max("created_ts").alias("last_message_ts"),
            F.bool_or("has_query_attachment").alias("has_sql_output"),
            F.bool_or(failed).alias("has_errors"),
            F.bool_or(rated).alias("has_feedback"),
        )
        .withColumn(
            "conversation_duration_sec",
            F.when(
                F.col("first_message_ts") != F.col("last_message_ts"),
                (F.unix_micros("last_message_ts") - F.unix_micros("first_message_ts")) / F.lit(1e6),
            ),
        )
        .select("space_id", "conversation_id", "message_count", "completed_count", "failed_count",
                "first_message_ts", "last_message_ts", "conversation_duration_sec", "has_sql_output", "has_errors",
                "has_feedback")
    )


def with_empty_conversations(conversations: DataFrame, rollup: DataFrame, harvested_at=None) -> DataFrame:
    """Every conversation once, as last updated, with its rollup; one without messages has zeros, falses, no times."""
    once = latest_per_key(conversations, ["space_id", "conversation_id"], "last_updated_ts")
    return (
        once.join(rollup, ["space_id", "conversation_id"], "left")
        .na.fill(0, ["message_count", "completed_count", "failed_count"])
        .na.fill(False, ["has_sql_output", "has_errors", "has_feedback"])
        .withColumn("harvested_at", instant_of(harvested_at))
        .select(*_CONVERSATION_COLUMNS)
    )


# --- curation and benchmark ---------------------------------------------------------------------
def flatten_eval_runs(raw: DataFrame) -> DataFrame:
    return _items(raw, schemas.EVAL_RUNS_PAYLOAD, "eval_runs").select(
        "space_id", "i.eval_run_id", "i.eval_run_status", _int("i.num_questions").alias("num_questions"),
        _int("i.num_correct").alias("num_correct"), _int("i.num_needs_review").alias("num_needs_review"),
        _int("i.num_done").alias("num_done"), _long("i.created_timestamp").alias("created_timestamp"),
        "i.run_by_user",
    )


def flatten_instructions(raw: DataFrame) -> DataFrame:
    """Instructions; use_as_tool is written True or False, and stays null where it is not sent."""
    flag = F.col("i.use_as_tool")
    return _items(raw, schemas.INSTRUCTIONS_PAYLOAD, "instructions").select(
        "space_id", "i.instruction_id", "i.instruction_type", "i.title", "i.content", "i.usage_guidance",
        "i.instruction_status", F.when(flag.isin("true", "false"), F.initcap(flag)).otherwise(flag).alias("use_as_tool"),
    )


def flatten_curated_questions(raw: DataFrame) -> DataFrame:
    return _items(raw, schemas.CURATED_PAYLOAD, "curated_questions").select(
        "space_id", "i.curated_question_id", "i.question_type", "i.question_text", "i.answer_text", "i.eval_note",
        F.coalesce(F.lower("i.is_deprecated") == "true", F.lit(False)).alias("is_deprecated"),
    )


def latest_run_for_results(runs: DataFrame) -> DataFrame:
    """The run of every space whose results are harvested; a run without a time counts as the oldest."""
    return runs.groupBy("space_id").agg(F.max_by("eval_run_id", run_recency()).alias("eval_run_id"))


def flatten_eval_results(listed: DataFrame, detail: DataFrame, chars: int | None = None) -> DataFrame:
    """Listed results with the assessment and responses of their detail; a missing response stays null.

    Responses are whole, or their first `chars` characters.
    """
    items = _items(listed, schemas.RESULT_LIST_PAYLOAD, "eval_results").select("space_id", "eval_run_id", "i.*")
    full = _parsed(detail, schemas.RESULT_DETAIL_PAYLOAD)
    return items.join(full, ["space_id", "eval_run_id", "result_id"], "left").select(
        "space_id", "eval_run_id", "benchmark_question_id", "question", "assessment",
        clipped("expected_response", chars),
        clipped("actual_response", chars), "result_id",
    )
