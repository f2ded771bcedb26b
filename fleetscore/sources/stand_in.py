"""The test tables seen as bronze tables and as landed payloads.

Every row of a table is used. Keys are mapped so that the corner cases occur: some spaces have no
messages, runs or instructions, and some messages and runs belong to spaces that are not in meta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.operators.ranking import ordered_rank
from fleetscore.sources.bronze import scan_bronze

PAGE_MESSAGES = 50
# The columns of the test tables; declared, so that opening one needs no job.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate "
              "timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus "
                "string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan_bronze(spark, sf_dir, f"{name}.parquet", COLUMNS[name])


def _space(number: Column) -> Column:
    return F.concat(F.lit("sp"), number.cast("string"))


def _moved(number: Column, taken: int, to: int) -> Column:
    """Leaves one space without rows by giving them to another."""
    return F.when(number == taken, to).otherwise(number)


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


# --- bronze -------------------------------------------------------------------------------------
def messages_from(events: DataFrame) -> DataFrame:
    """One message per event; works on a stream as well."""
    kind, value, event_id = F.col("event_type"), F.col("value"), F.col("event_id")
    home = F.col("user_id") % 27
    ts = F.col("ts").cast("timestamp")
    micros = F.unix_micros(ts) + F.round(value * 1000000).cast("bigint")
    status = (
        F.when(event_id % 500 == 0, F.lit(None))
        .when(kind == "error", "FAILED")
        .when((kind == "click") & (value > 150), "EXECUTING_QUERY")
        .otherwise("COMPLETED")
    )
    error = F.when((kind == "error") & (value > 20), "SQL_EXECUTION_EXCEPTION").when(
        (kind == "view") & (event_id % 97 == 0), "RATE_LIMIT"
    )
    rating = (
        F.when((kind == "signup") & (home % 3 == 0), "NEGATIVE")
        .when(kind == "signup", "POSITIVE")
        .when((kind == "purchase") & (value < 20), "NEGATIVE")
        .when((kind == "view") & (value > 100), "NEUTRAL")
    )
    conversation = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(ts, "yyyyMMdd"))
    return events.select(
        _space(_moved(home, 3, 27)).alias("space_id"),
        conversation.alias("conversation_id"),
        event_id.cast("string").alias("message_id"),
        "user_id",
        F.concat(F.lit("question "), F.get_json_object("props", "$.k")).alias("user_question"),
        status.alias("status"),
        ts.alias("created_ts"),
        F.timestamp_micros(micros).alias("completed_ts"),
        F.when(event_id % 211 != 0, value).alias("response_time_sec"),
        F.when(kind == "purchase", F.concat(F.lit("SELECT "), event_id.cast("string"))).alias("sql_generated"),
        error.alias("error_type"),
        F.when(error.isNotNull(), F.concat(F.lit("failed after "), value.cast("string"))).alias("error_message"),
        rating.alias("feedback_rating"),
        (kind == "purchase").alias("has_query_attachment"),
        (ts + F.expr("INTERVAL 1 DAY")).alias("harvested_at"),
    )


def conversations_from(messages: DataFrame) -> DataFrame:
    """A conversation per user and day, as its messages show it."""
    return messages.groupBy("space_id", "conversation_id").agg(
        F.min("user_id").alias("user_id"),
        F.min("created_ts").alias("created_ts"),
        F.max("completed_ts").alias("last_updated_ts"),
        F.count("*").cast("int").alias("message_count"),
        F.max("harvested_at").alias("harvested_at"),
    )


def run_space(custkey: Column) -> Column:
    return _space(_moved(custkey % 25, 7, 30))


def runs_from(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One benchmark run per order; its lines are the questions."""
    flag = F.col("l_returnflag")
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.count_if(flag == "A").alias("a"), F.count_if(flag == "N").alias("r")
    )
    key = F.col("o_orderkey")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    done = F.when(F.col("o_orderstatus") == "O", F.lit(None)).when(
        (F.col("o_orderstatus") == "P") & (key % 10 == 0), 0
    ).otherwise(number("n"))
    return orders.join(lines, "o_orderkey", "left").select(
        run_space(F.col("o_custkey")).alias("space_id"), key.cast("string").alias("eval_run_id"),
        F.when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("DONE").alias("eval_run_status"),
        number("n").alias("num_questions"), number("a").alias("num_correct"), number("r").alias("num_needs_review"),
        done.cast("int").alias("num_done"),
        F.when(key % 101 != 0, _ms(F.col("o_orderdate"))).alias("created_timestamp"),
        F.concat(F.lit("user "), F.col("o_custkey").cast("string")).alias("run_by_user"),
    )


def results_from(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """One benchmark result per line of an order."""
    text = lambda c: F.col(c).cast("string")
    result_id = F.concat_ws(
        "-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey"),
        F.col("l_quantity").cast("int").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"),
    )
    assessment = F.when(F.col("l_returnflag") == "A", "GOOD").when(
        F.col("l_returnflag") == "R", "BAD").otherwise("NEEDS_REVIEW")
    asked = part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    homes = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lineitem.join(homes, "l_orderkey").join(asked, "l_partkey").select(
        run_space(F.col("o_custkey")).alias("space_id"), text("l_orderkey").alias("eval_run_id"),
        text("l_partkey").alias("benchmark_question_id"), F.col("p_name").alias("question"),
        assessment.alias("assessment"), F.concat(F.lit("SELECT "), text("l_partkey")).alias("expected_response"),
        F.when(F.col("l_linenumber") < 7, F.concat(F.lit("SELECT "), text("l_suppkey"))).alias("actual_response"),
        result_id.alias("result_id"),
    )


def instructions_from(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One instruction per document."""
    home = F.col("doc_id") % 20
    kind = (
        F.when(home == 4, "TEXT_INSTRUCTION").when(home == 5, "SQL_INSTRUCTION")
        .when(F.col("lang") == "en", "SQL_INSTRUCTION").otherwise("TEXT_INSTRUCTION")
    )
    return documents.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        _space(_moved(home, 6, 40)).alias("space_id"), F.col("doc_id").cast("string").alias("instruction_id"),
        kind.alias("instruction_type"), F.col("source").alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("for "), "lang").alias("usage_guidance"),
        F.when(F.col("quality") == 1, "ACCEPTED").when(F.col("quality") == 0, "PROPOSED").alias("instruction_status"),
        F.when(home != 0, F.when(F.col("n_chars") > 500, "True").otherwise("False")).alias("use_as_tool"),
    )


def curated_from(part: DataFrame) -> DataFrame:
    """One curated question per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when((F.col("p_type") == "PROMO") & (size % 10 == 0), "BENCHMARK").otherwise("SAMPLE_QUESTION")
    return part.select(
        _space(key % 20 + 5).alias("space_id"), key.cast("string").alias("curated_question_id"),
        kind.alias("question_type"), F.col("p_name").alias("question_text"),
        F.concat(F.lit("SELECT "), F.col("p_size").cast("string")).alias("answer_text"),
        F.col("p_brand").alias("eval_note"), F.when(size != 50, size < 5).alias("is_deprecated"),
    )


def meta_from(nation: DataFrame, region: DataFrame, supplier: DataFrame) -> DataFrame:
    """One space per nation. Its tables are the price classes of its suppliers, of which there are few."""
    price_class = F.floor(F.col("s_acctbal") / 1000)
    tables = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.array_sort(F.collect_set(F.concat(F.lit("sales.t"), price_class.cast("string")))).alias("tables")
    )
    key = F.col("n_nationkey")
    changed = F.lit(1704067200000).cast("bigint") + key.cast("bigint") * 86400000
    return (
        nation.join(region, nation.n_regionkey == region.r_regionkey)
        .join(tables, "n_nationkey", "left")
        .select(
            _space(key).alias("space_id"), F.col("n_name").alias("title"), F.col("r_name").alias("owner"),
            F.concat(F.lit("/Users/"), "r_name", F.lit("/x")).alias("parent_path"),
            F.when(key % 9 != 0, F.concat(F.lit("wh"), (key % 6).cast("string"))).alias("warehouse_id"),
            F.when(key % 2 == 0, "VIEWER").otherwise("OWNER").alias("run_as_type"),
            changed.alias("last_updated_timestamp"),
            F.coalesce("tables", F.array().cast("array<string>")).alias("table_identifiers"),
        )
    )


def spaces_from(supplier: DataFrame) -> DataFrame:
    """One space per supplier, each harvested twice; the later version has another title."""
    key = F.col("s_suppkey")
    versions = supplier.withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    title = F.when((F.col("v") == 2) & (key % 5 == 0), "").when(
        F.col("v") == 2, F.concat("s_name", F.lit(" II"))).otherwise(F.col("s_name"))
    path = (
        F.when(key % 4 == 0, F.lit(None))
        .when(key % 4 == 1, F.concat(F.lit("/Users/u"), F.col("s_nationkey").cast("string"), F.lit("/spaces")))
        .when(key % 4 == 2, F.lit("/Shared/spaces"))
        .otherwise(F.concat(F.lit("/Workspace/Users/u"), F.col("s_nationkey").cast("string")))
    )
    return versions.select(
        F.concat(F.lit("assistant-"), key.cast("string")).alias("space_id"), title.alias("title"),
        F.when(key % 3 != 0, F.concat(F.lit("about "), "s_name")).alias("description"),
        F.when(key % 9 != 0, F.concat(F.lit("wh"), (key % 6).cast("string"))).alias("warehouse_id"),
        path.alias("parent_path"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(v, 0, 0, 0)").alias("harvested_at"),
    )


def warehouses_from(customer: DataFrame) -> DataFrame:
    """The warehouses that are there."""
    number = (F.col("c_nationkey") % 5).cast("string")
    return customer.select(F.concat(F.lit("wh"), number).alias("warehouse_id")).distinct()


class Bronze:
    """All bronze tables by name, as plans over the test tables; a plan is made when it is asked for."""

    _MAKERS = {
        "message_details": (messages_from, "events"),
        "eval_runs": (runs_from, "orders", "lineitem"),
        "eval_results": (results_from, "lineitem", "orders", "part"),
        "instructions": (instructions_from, "documents", "labels"),
        "curated_questions": (curated_from, "part"),
        "space_meta": (meta_from, "nation", "region", "supplier"),
        "spaces": (spaces_from, "supplier"),
        "warehouses": (warehouses_from, "customer"),
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._tables, self._made = spark, sf_dir, {}, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = table(self._spark, self._dir, name)
        return self._tables[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name == "conversations":
                self._made[name] = conversations_from(self["message_details"])
            else:
                maker, *tables = self._MAKERS[name]
                self._made[name] = maker(*[self.table(t) for t in tables])
        return self._made[name]


# --- landed payloads ----------------------------------------------------------------------------
def _document(df: DataFrame, **fields: Column | str) -> DataFrame:
    return df.select(F.to_json(F.struct(*[
        (F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()
    ])).alias("payload"))


def space_payloads(supplier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """List and detail of every space: the list knows less, the detail has some empty texts."""
    s = spaces_from(supplier).where(F.col("harvested_at") == F.lit("2024-01-02").cast("timestamp"))
    number = F.substring_index("space_id", "-", -1).cast("bigint")
    listed = _document(s, space_id="space_id", title="title", description=F.lit("listed"), warehouse_id="warehouse_id")
    detail = _document(
        s, space_id="space_id", title=F.lit("ignored"),
        description=F.when(number % 7 == 0, "").otherwise(F.col("description")),
        warehouse_id=F.when(number % 5 == 0, "").otherwise(F.concat(F.lit("d-"), "warehouse_id")),
        parent_path="parent_path",
    )
    return listed, detail


def message_payloads(events: DataFrame) -> DataFrame:
    """One page per event with one message that has every kind of attachment, error and feedback."""
    kind, value, n = F.col("event_type"), F.col("value"), F.col("event_id")
    text = n.cast("string")
    ms = _ms(F.col("ts"))
    tag = lambda prefix: F.concat(F.lit(prefix), text)

    def attachment(attachment_id=None, query=None, said=None, questions=None):
        q = query if query is not None else F.lit(None).cast(
            "struct<id:string,query:string,title:string,description:string,statement_id:string,"
            "last_updated_timestamp:bigint,parameters:array<struct<keyword:string,sql_type:string,value:string>>,"
            "query_result_metadata:struct<row_count:bigint,is_truncated:boolean>>")
        t = said if said is not None else F.lit(None).cast("struct<id:string,content:string,purpose:string>")
        s = questions if questions is not None else F.lit(None).cast("struct<questions:array<string>>")
        i = attachment_id if attachment_id is not None else F.lit(None).cast("string")
        return F.struct(i.alias("attachment_id"), q.alias("query"), t.alias("text"), s.alias("suggested_questions"))

    def query(prefix):
        parameter = F.struct(F.lit("region").alias("keyword"), F.lit("STRING").alias("sql_type"), tag("v").alias("value"))
        none = F.array().cast("array<struct<keyword:string,sql_type:string,value:string>>")
        result = F.struct((n * 3).alias("row_count"), (n % 2 == 0).alias("is_truncated"))
        return F.struct(
            tag(f"{prefix}i").alias("id"), F.concat(F.lit("SELECT "), text).alias("query"),
            tag(f"{prefix}title ").alias("title"), F.when(n % 3 != 0, tag("about ")).alias("description"),
            F.when(n % 11 == 0, "").otherwise(tag(f"{prefix}st")).alias("statement_id"),
            F.when(n % 13 == 0, 0).otherwise(ms + 500).alias("last_updated_timestamp"),
            F.when(n % 2 == 0, F.array(parameter)).otherwise(none).alias("parameters"),
            F.when(n % 4 != 0, result).alias("query_result_metadata"),
        )

    said = F.struct(tag("ti").alias("id"), tag("answer ").alias("content"),
                    F.when(n % 2 == 0, "CLARIFICATION").alias("purpose"))
    ask = F.struct(F.array(tag("more "), F.lit("why?")).alias("questions"))
    no_ask = F.struct(F.array().cast("array<string>").alias("questions"))
    attachments = (
        F.when((kind == "purchase") & (n % 5 == 0), F.array(
            attachment(tag("a"), query("x")), attachment(tag("b"), query("y")), attachment(tag("c"), said=said)))
        .when(kind == "purchase", F.array(attachment(None, query("x")), attachment(None, said=said)))
        .when(kind == "view", F.array(attachment(tag("t"), said=said)))
        .when(kind == "signup", F.array(
            attachment(questions=F.when(n % 2 == 0, ask).otherwise(no_ask)), attachment(tag("t"), said=said)))
        .when(kind == "click", F.array().cast(
            "array<struct<attachment_id:string,query:struct<id:string,query:string,title:string,description:string,"
            "statement_id:string,last_updated_timestamp:bigint,parameters:array<struct<keyword:string,"
            "sql_type:string,value:string>>,query_result_metadata:struct<row_count:bigint,is_truncated:boolean>>,"
            "text:struct<id:string,content:string,purpose:string>,"
            "suggested_questions:struct<questions:array<string>>>>"))
    )
    message = F.struct(
        F.when(n % 7 == 0, "").otherwise(tag("m")).alias("message_id"), tag("id").alias("id"),
        F.col("user_id"), F.concat(F.lit("question "), F.get_json_object("props", "$.k")).alias("content"),
        F.when(kind == "error", "FAILED").otherwise("COMPLETED").alias("status"),
        ms.alias("created_timestamp"),
        F.when(n % 223 == 0, 0).when(n % 211 != 0, ms + F.round(value * 1000).cast("bigint"))
        .alias("last_updated_timestamp"),
        attachments.alias("attachments"),
        F.when(n % 3 == 0, F.struct(tag("legacy").alias("statement_id"), (n + 1).alias("row_count"),
                                    (n % 6 == 0).alias("is_truncated"))).alias("query_result"),
        F.when(kind == "error", F.struct(F.lit("SQL_EXECUTION_EXCEPTION").alias("type"), tag("bad ").alias("error")))
        .alias("error"),
        F.when((kind == "view") & (value > 50), F.struct(F.lit("POSITIVE").alias("rating"))).alias("feedback"),
    )
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    conversation = F.struct(
        F.concat_ws("-", F.col("user_id").cast("string"), day).alias("conversation_id"), F.lit("chat").alias("title"),
        F.col("user_id"),
    )
    return _document(events, space_id=_space(F.col("user_id") % 27), space_title=F.lit("a space"),
                     conversation=conversation, messages=F.array(message))


def conversation_payloads(turns: DataFrame) -> DataFrame:
    """Real conversations: a message per user turn with the assistant's next turn as its text.

    A page holds up to PAGE_MESSAGES messages, so a conversation of any length is landed in bounded
    documents. Every ninth conversation has lost its id, and is taken by its other one or skipped.
    """
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", "text")
    numbered = ordered_rank(asked, ["conv_id"], [F.col("turn").asc()], "place").join(answers, ["conv_id", "turn"], "left")
    said = F.when(F.col("answer").isNotNull(), F.array(F.struct(
        F.concat_ws(".", F.lit("a"), "conv_id", "turn").alias("attachment_id"),
        F.struct(F.col("answer").alias("content")).alias("text"))))
    start = F.lit(1704067200000).cast("bigint") + F.col("conv_id") * 60000
    message = F.struct(
        F.concat_ws(".", F.lit("m"), "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("user_id"),
        F.col("text").alias("content"), F.when(F.col("answer").isNull(), "FAILED").otherwise("COMPLETED").alias("status"),
        (start + F.col("turn") * 1000).alias("created_timestamp"),
        (start + F.col("turn") * 1000 + F.length("text")).alias("last_updated_timestamp"), said.alias("attachments"),
    )
    page = F.floor((F.col("place") - 1) / PAGE_MESSAGES).cast("bigint")
    pages = numbered.groupBy("conv_id", page.alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("place", message.alias("m")))).alias("listed")
    )
    # Conversations nobody has written in yet are landed too.
    silent = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n")).where(F.col("n") == 0)
    everything = pages.unionByName(
        silent.select("conv_id", F.lit(0).cast("bigint").alias("page")), allowMissingColumns=True
    )
    c = F.col("conv_id")
    conversation = F.struct(
        F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("c"), c.cast("string"))).alias("conversation_id"),
        F.when(c % 18 != 0, F.concat(F.lit("c"), c.cast("string"))).alias("id"),
        F.concat(F.lit("chat "), c.cast("string")).alias("title"), c.alias("user_id"),
        (F.lit(1704067200000).cast("bigint") + c * 60000).alias("created_timestamp"),
        F.when(c % 10 == 0, 0).otherwise(F.lit(1704067200000).cast("bigint") + c * 60000 + 30000)
        .alias("last_updated_timestamp"),
    )
    return _document(everything, space_id=_space(c % 25), space_title=F.concat(F.lit("Space "), (c % 25).cast("string")),
                     conversation=conversation, offset=F.col("page") * PAGE_MESSAGES, messages=F.col("listed.m"))


def eval_run_payloads(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A page per run; some counts are sent as text, some cannot be read."""
    r = runs_from(orders, lineitem)
    number = F.col("eval_run_id").cast("bigint")
    review = F.when(number % 17 == 0, "n/a").otherwise(F.col("num_needs_review").cast("string"))
    run = F.struct("eval_run_id", "eval_run_status", F.col("num_questions").cast("string").alias("num_questions"),
                   "num_correct", review.alias("num_needs_review"), "num_done", "created_timestamp", "run_by_user")
    return _document(r, space_id="space_id", eval_runs=F.array(run))


def instruction_payloads(documents: DataFrame, labels: DataFrame) -> DataFrame:
    i = instructions_from(documents, labels)
    tool = F.when(F.col("use_as_tool").isNotNull(), F.col("use_as_tool") == "True").alias("use_as_tool")
    one = F.struct("instruction_id", "instruction_type", "title", "content", "usage_guidance", "instruction_status", tool)
    return _document(i, space_id="space_id", instructions=F.array(one))


def curated_payloads(part: DataFrame) -> DataFrame:
    """Deprecation is sent as a flag for some questions and as text for others."""
    q = curated_from(part)
    flag = F.col("is_deprecated").cast("string")
    number = F.col("curated_question_id").cast("bigint")
    one = F.struct("curated_question_id", "question_type", "question_text", "answer_text", "eval_note",
                   F.when(number % 2 == 0, F.upper(flag)).otherwise(flag).alias("is_deprecated"))
    return _document(q, space_id="space_id", curated_questions=F.array(one))


def meta_payloads(supplier: DataFrame) -> DataFrame:
    """Settings of every supplier's space; some name no tables."""
    s = spaces_from(supplier).where(F.col("harvested_at") == F.lit("2024-01-03").cast("timestamp"))
    number = F.substring_index("space_id", "-", -1).cast("bigint")
    tables = F.when(number % 3 != 0, F.array(F.concat(F.lit("sales.t"), number.cast("string")), F.lit("sales.all")))
    return _document(s, space_id="space_id", title="title", parent_path="parent_path", warehouse_id="warehouse_id",
                     run_as_type=F.lit("VIEWER"), last_updated_timestamp=F.lit(1704067200000).cast("bigint") + number,
                     table_identifiers=tables)


def result_payloads(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists with one result each, and details for all that are not waiting for review."""
    item = F.struct("result_id", "benchmark_question_id", "question")
    listed = _document(results, space_id="space_id", eval_run_id="eval_run_id", eval_results=F.array(item))
    found = results.where(F.col("assessment") != "NEEDS_REVIEW")
    long = F.when(F.length("benchmark_question_id") <= 2, F.repeat("expected_response", 700))
    detail = _document(found, space_id="space_id", eval_run_id="eval_run_id", result_id="result_id",
                       assessment="assessment", expected_response=F.coalesce(long, "expected_response"),
                       actual_response="actual_response")
    return listed, detail


# --- replies ------------------------------------------------------------------------------------
def step_replies(instructions: DataFrame) -> DataFrame:
    """What a model might answer about every instruction: good, wordy, broken, off topic or empty replies."""
    doc = F.col("instruction_id")
    number = doc.cast("bigint")

    def step(category, evidence, impact=None):
        fields = [F.lit(f'{{"category":"{category}","step":"reword","why":"see text","evidence":"'), evidence, F.lit('"')]
        return F.concat(*fields, F.lit(f',"impact":"{impact}"}}' if impact else "}"))

    cite = F.concat(F.lit("instruction_id "), doc)
    steps = lambda *s: F.concat(F.lit('{"steps":['), F.concat_ws(",", *s), F.lit("]}"))
    reply = (
        F.when(number % 5 == 0, steps(step("CONFLICTING_INSTRUCTIONS", cite, "high")))
        .when(number % 5 == 1, F.concat(
            F.lit("Here you are:\n```json\n"),
            steps(step("BAD_GROUND_TRUTH", F.lit("see zz"), "high"), step("CONFLICTING_INSTRUCTIONS", cite)),
            F.lit("\n```\n")))
        .when(number % 5 == 2, F.lit('{"steps":[{"category":'))
        .when(number % 5 == 3, steps(
            step("LOW_ACCURACY", cite, "high"),
            step("BAD_GROUND_TRUTH", F.concat(F.lit("row "), (number * 1000 + 7).cast("string")), "severe")))
        .otherwise(F.lit("Nothing found."))
    )
    return instructions.select("space_id", number.alias("part"), reply.alias("reply"))


def verdict_replies(documents: DataFrame) -> DataFrame:
    """A verdict per document in changing case and layout; some are not in the form asked for."""
    n = F.col("doc_id") % 4
    letter = F.substring(F.lit("ABCDF"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1))
    return documents.select(
        "doc_id",
        F.when(n == 0, F.concat(F.lit("GRADE: "), letter, F.lit(" | WHY: from "), "source", F.lit(" | FIX: "), "lang"))
        .when(n == 1, F.concat(F.lit("Well.\n grade:"), F.lower(letter), F.lit("|why:\n "), "source",
                               F.lit("\n | fix:  "), "lang", F.lit(" \n")))
        .when(n == 2, F.concat(F.lit("  "), "text", F.lit(" \n")))
        .alias("reply"),
    )


def space_verdicts(factors: DataFrame) -> DataFrame:
    """A verdict per active space, by how often it fails."""
    letter = F.when(F.col("error_pct") < 20, "B").when(F.col("error_pct") < 21, "c").otherwise("F")
    return factors.select("space_id", F.concat(
        F.lit("GRADE: "), letter, F.lit(" | WHY: errors | FIX: look")).alias("reply"))
