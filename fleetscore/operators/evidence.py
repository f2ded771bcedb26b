"""Evidence a model is shown for a space, and the check that its advice rests on that evidence."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetscore.functions.columns import BENCHMARK, SQL_INSTRUCTION, TEXT_INSTRUCTION, blank_to_null, tally
from fleetscore.operators.ranking import running, top_k
from fleetscore.session import stored_meanwhile, with_known_size

# Fixed names of the figures a bundle carries.
METRICS = [
    "benchmark_questions_defined", "num_runs", "coverage_pct", "benchmark_quality_pct", "sql_instructions",
    "text_instructions", "feedback_positive_pct", "thumbs_down", "msgs",
]
# The problems a model may report; everything else is left to the rules.
MODEL_CATEGORIES = ["CONFLICTING_INSTRUCTIONS", "BAD_GROUND_TRUTH"]
TASK = (
    "You are given, as JSON, the tables, instructions, benchmark questions and latest results of one data assistant. "
    "Report two kinds of problem only. CONFLICTING_INSTRUCTIONS: two instructions that cannot both be followed, such as "
    "two meanings of one term. BAD_GROUND_TRUTH: a question whose expected SQL is itself wrong, for example a column that "
    "does not exist or an answer to another question. Answer with JSON alone: {\"steps\": [{\"category\", \"step\", \"why\", "
    "\"evidence\", \"impact\"}]}, where evidence names the ids it rests on and impact is high, medium or low. "
    "If there is nothing to report, answer {\"steps\": []}."
)
SCHEMA_TYPE = "map<string,array<string>>"
# What a bundle lists of each kind of item, with its ids and its JSON texts.
LISTED = [("instructions", "instruction_ids", "instructions_json"), ("benchmark_questions", "question_ids", "benchmark_questions_json"),
          ("benchmark_results", "result_ids", "benchmark_results_json")]
# Parts of a space are made together, from one copy of their items, as long as these numbers allow.
SHELF_PARTS, SHELF_CHARS = 1_024, 64_000_000
# Parts of a shelf that one task makes; a writer may hold all of them.
TASK_PARTS = 36
_STEPS_TYPE = "array<struct<steps:array<struct<category:string,step:string,why:string,evidence:string,impact:string>>>>"


def _instruction() -> Column:
    return F.struct("instruction_id", "instruction_type", "title", "content")


def _question() -> Column:
    return F.struct(F.col("curated_question_id").alias("benchmark_question_id"), "question_text", "answer_text")


def _result() -> Column:
    return F.struct(
        "benchmark_question_id", "question", "assessment", F.col("expected_response").alias("expected_sql"),
        F.col("actual_response").alias("actual_sql"), "result_id",
    )


def _chars(*names: str) -> Column:
    return sum((F.coalesce(F.length(n), F.lit(0)) for n in names), F.lit(0)).cast("bigint")


def _items(instructions: DataFrame, curated: DataFrame, results: DataFrame) -> DataFrame:
    """All evidence as rows: uid, space_id, kind, together (items of one kind and this name lie side by side), id, chars,
    and the item itself in the column of its kind. In the order of uid, the items of a kind and space are sorted by their values."""
    title = blank_to_null(F.lower(F.trim("title")))
    questions = curated.where(F.col("question_type") == BENCHMARK)
    parts = (
        instructions.select(
            "space_id", F.lit(0).alias("kind"), F.coalesce(title, "instruction_id").alias("together"), F.col("instruction_id").alias("id"),
            _chars("title", "content").alias("chars"), _instruction().alias("instruction")),
        questions.select(
            "space_id", F.lit(1).alias("kind"), F.col("curated_question_id").alias("together"), F.col("curated_question_id").alias("id"),
            _chars("question_text", "answer_text").alias("chars"), _question().alias("question")),
        results.select(
            "space_id", F.lit(2).alias("kind"), F.coalesce("benchmark_question_id", "result_id").alias("together"), F.col("result_id").alias("id"),
            _chars("question", "expected_response", "actual_response").alias("chars"), _result().alias("result")),
    )
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    ordered = rows.where("space_id is not null").sort("space_id", "kind", "instruction", "question", "result")
    return with_known_size(ordered.withColumn("uid", F.monotonically_increasing_id()), "evidence-items")


def _words() -> Column:
    """What is indexed of an item: title and content of an instruction, text and answer of a question."""
    return F.when(F.col("kind") == 0, F.concat_ws(" ", "instruction.title", "instruction.content")).otherwise(
        F.concat_ws(" ", "question.question_text", "question.answer_text"))


def _terms(words: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(words), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _term_parts(items: DataFrame, placed: DataFrame, part_items: int, part_chars: int, scratch: ExitStack) -> DataFrame:
    """(uid, space_id, part): items of different home parts meet once more in the parts of the terms they share.

    An inverted index, from the terms of instructions and questions to the items that use them. A term is kept if its
    items fit one part and lie in several; terms with the same items count once. Terms in alphabetical order fill parts
    behind the home parts, and take all their items along. The index stays until `scratch` is closed.
    """
    wide = placed.groupBy("space_id").agg((F.max("home") + 1).alias("n_home")).where("n_home > 1")
    if wide.isEmpty():
        return placed.select("uid", "space_id", F.col("home").alias("part")).where("false")
    # Small columns of known size: where they are broadcast, texts don't move.
    homes = with_known_size(placed.where("kind < 2").join(wide, "space_id").select("uid", "space_id", "home"), "evidence-homes")
    postings = (
        items.where("kind < 2").select("uid", "chars", _terms(_words()).alias("terms")).join(homes, "uid")
        .select("space_id", "home", "uid", "chars", F.explode("terms").alias("term")).repartition("space_id", "term"))
    term = Window.partitionBy("space_id", "term")
    kept = postings.withColumns({
        "n": F.count("*").over(term), "all_chars": F.sum("chars").over(term), "first": F.min("home").over(term), "last": F.max("home").over(term),
    }).where((F.col("first") < F.col("last")) & (F.col("n") <= part_items) & (F.col("all_chars") <= part_chars))
    # Only the lists of terms that are kept are made; they have part_items items at most.
    index = scratch.enter_context(stored_meanwhile(kept.groupBy("space_id", "term").agg(
        F.first("n").alias("n"), F.first("all_chars").alias("chars"), F.bit_xor(F.xxhash64("uid")).alias("who"),
        F.collect_list("uid").alias("uids")), "evidence-index"))
    least = F.array_min("uids").alias("low"), F.array_max("uids").alias("high")
    terms = index.select("space_id", "term", "n", "chars", "who", *least).groupBy("space_id", "n", "chars", "low", "high", "who").agg(
        F.min("term").alias("term"))
    packed = running(terms.select("space_id", "term", "n", "chars"), ["space_id"], [F.col("term").asc()], "_at",
                     {"items_before": "n", "chars_before": "chars"})
    packed = packed.join(wide, "space_id").select(
        "space_id", "term", (F.col("n_home") + _part("items_before", "chars_before", part_items, part_chars)).alias("part"))
    return index.select("space_id", "term", "uids").join(packed, ["space_id", "term"]).select(
        F.explode("uids").alias("uid"), "space_id", "part")


def _part(items_before: str, chars_before: str, part_items: int, part_chars: int) -> Column:
    return F.greatest(F.floor(F.col(items_before) / part_items), F.floor(F.col(chars_before) / part_chars)).cast("bigint")


def evidence_bundle(
    scorecard: DataFrame, instructions: DataFrame, curated: DataFrame, results: DataFrame,
    part_items: int = 500, part_chars: int = 4_000_000, shelf_parts: int = SHELF_PARTS, shelf_chars: int = SHELF_CHARS,
) -> DataFrame:
    """Metrics, instructions, benchmark questions (deprecated ones too) and results of every space, in parts.

    One rule for spaces of any size; nothing is left out, and no part grows with its space:
    - Items lie in order of instructions by title, then questions each with its results, and a part ends after
      `part_items` items or `part_chars` characters. So every item has a home part, also where one title or one question
      has more items than a part holds. A question is copied to each part that holds results of it.
    - Two items that use a common term meet in some part: at home, or in a part of that term, if its items fit one part.
      A term part has at most twice the limits. No term is in question while a space has one part.
    - Parts are numbered from 0 by place; a number may stay unused. A space without items has one empty part.
    - instruction_ids, question_ids and result_ids name what a part holds. Who reads only these moves no texts to the parts.
    - instructions_json, benchmark_questions_json and benchmark_results_json are the items as JSON, each written once for all parts.
    - An item moves once to a shelf of up to `shelf_parts` parts, not once to each part. If a space has more than `shelf_chars`
      characters, its shelves end after that many characters of parts, so a shelf never holds more than that and one part.
    """
    items = _items(instructions, curated, results)
    narrow = items.select("uid", "space_id", "kind", "together", "id", "chars", F.when(F.col("kind") == 0, 0).otherwise(1).alias("side"))
    order = [F.col("side").asc(), F.col("together").asc_nulls_first(), F.col("kind").asc(), F.col("id").asc_nulls_first(), F.col("uid").asc()]
    placed = running(narrow, ["space_id"], order, "items_before", {"chars_before": "chars"}).withColumn(
        "home", _part("items_before", "chars_before", part_items, part_chars))
    at_home = placed.select("uid", "space_id", F.col("home").alias("part"))
    asked = placed.where("kind = 2").select("space_id", "together", F.col("home").alias("part")).distinct()
    copies = placed.where("kind = 1").join(asked, ["space_id", "together"]).where("part != home").select("uid", "space_id", "part")
    # One row per item with all its parts.
    with ExitStack() as scratch:
        places = at_home.unionByName(copies).unionByName(_term_parts(items, placed, part_items, part_chars, scratch))
        places = with_known_size(
            places.repartition("uid").groupBy("uid").agg(F.first("space_id").alias("space_id"), F.collect_set("part").alias("parts")), "evidence-places")
    seats = _seats(placed, places, shelf_parts, shelf_chars)
    counts = seats.select("space_id", "part").distinct().groupBy("space_id").agg(F.count("*").alias("n_parts"))
    kept = scorecard.select("space_id", "title", F.struct(*METRICS).alias("metrics"))
    spaces = with_known_size(kept.join(counts, "space_id"), "evidence-spaces")
    filled = _filled_parts(items, seats, spaces)
    listed = [name for names in zip(*LISTED) for name in names]
    bare = kept.join(spaces, "space_id", "left_anti").select(
        "space_id", "title", "metrics", F.lit(1).cast("bigint").alias("n_parts"), F.lit(0).cast("bigint").alias("part"),
        *[F.array().cast(filled.schema[name].dataType).alias(name) for name in listed])
    return filled.unionByName(bare).withColumn("schema", F.create_map().cast(SCHEMA_TYPE)).select(
        "space_id", "title", "part", "n_parts", "metrics", "schema", *listed)


def _seats(placed: DataFrame, places: DataFrame, shelf_parts: int, shelf_chars: int) -> DataFrame:
    """(space_id, shelf, part, kind, uid, seat): the items of each part, and where an item lies among those of its kind on the shelf.
    A shelf belongs to one space."""
    slots = places.join(placed.select("uid", "kind", "chars"), "uid").select("uid", "space_id", "kind", "chars", F.explode("parts").alias("part"))
    before = running(slots.groupBy("space_id", "part").agg(F.sum("chars").alias("chars")), ["space_id"], [F.col("part").asc()],
                     "parts_before", {"chars_before": "chars"})
    wide = placed.groupBy("space_id").agg((F.sum("chars") > shelf_chars).alias("wide"))
    shelves = with_known_size(before.join(wide, "space_id").withColumn("chars_before", F.when(F.col("wide"), F.col("chars_before")).otherwise(0)).select(
        "space_id", "part", _part("parts_before", "chars_before", shelf_parts, shelf_chars).alias("shelf")), "evidence-shelves")
    dealt = _dealt(shelves.select("space_id", "shelf").distinct())
    shelves = with_known_size(shelves.join(dealt, ["space_id", "shelf"]).select("space_id", "part", F.col("label").alias("shelf")), "evidence-shelves")
    seat = F.dense_rank().over(Window.partitionBy("shelf", "kind").orderBy("uid")) - 1
    return with_known_size(
        slots.join(shelves, ["space_id", "part"]).select("space_id", "shelf", "part", "kind", "uid", seat.alias("seat")), "evidence-seats")


def _partitions(shelves: int) -> int:
    return min(1_000, max(1, shelves))


def _dealt(shelves: DataFrame) -> DataFrame:
    """shelves with a label each, by which a repartition to `_partitions` deals them out evenly; hashes of other keys would collide."""
    shelves = with_known_size(shelves, "evidence-shelves")
    n_shelves = shelves.count()
    n = _partitions(n_shelves)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("space_id", "shelf")) - 1
    place = F.row_number().over(Window.partitionBy("_at").orderBy("label")) - 1
    labels = shelves.sparkSession.range(64 * n_shelves + 10_000).select(F.col("id").alias("label"), F.pmod(F.hash("id"), F.lit(n)).alias("_at")).withColumn("_place", place)
    numbered = shelves.withColumn("_number", number).withColumns({"_at": F.col("_number") % n, "_place": F.floor(F.col("_number") / n)})
    return numbered.join(labels, ["_at", "_place"]).select("space_id", "shelf", "label")


def _filled_parts(items: DataFrame, seats: DataFrame, spaces: DataFrame) -> DataFrame:
    """The rows of `spaces` with the lists of every part. The items of a shelf are one row, which meets its parts one by one:
    what is moved are shelves and seats, while parts are made where they stay. Many tasks read the same moved shelf, each for
    other parts of it."""
    filled = seats.select("shelf", "part").distinct().groupBy("shelf").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    # A number of partitions that is given isn't lowered by the size of what moves, which is far below that of the parts.
    n, slices = _partitions(filled.n), -(-(filled.most or 1) // TASK_PARTS)
    of = lambda kind, value: F.when(F.col("kind") == kind, value)

    def parts(number: int) -> DataFrame:
        """The seats of the parts of a slice."""
        own = seats if slices == 1 else seats.where(F.pmod("part", F.lit(slices)) == number)
        return own.repartition(n, "shelf").groupBy("shelf", "space_id", "part").agg(
            *[F.sort_array(F.collect_list(of(kind, F.col("seat")))).alias(f"_seats{kind}") for kind in range(3)]).join(spaces, "space_id")

    written = [F.to_json(one, {"ignoreNullFields": "false"}) for one in (
        F.col("instruction"), F.col("question"), F.col("result").dropFields("result_id"))]
    ways = {"item": [F.col("instruction"), F.col("question"), F.col("result")], "id": [F.col("id")] * 3, "json": written}
    in_order = lambda kind, value: F.sort_array(F.collect_list(of(kind, F.struct("seat", value.alias("v")))))["v"]
    held = seats.select("shelf", "uid", "seat").distinct().join(items.drop("space_id"), "uid").repartition(n, "shelf").groupBy("shelf").agg(
        *[in_order(kind, value).alias(f"_{way}{kind}") for way, values in ways.items() for kind, value in enumerate(values)])
    # A merge join has one part with its shelf's items at a time; another join may gather those of a whole shelf.
    made = reduce(DataFrame.unionByName, [parts(number).join(held.hint("merge"), "shelf") for number in range(slices)])
    listed = {}
    for kind, names in enumerate(LISTED):
        for way, name in zip(ways, names):
            row = F.col(f"_{way}{kind}")
            taken = F.transform(f"_seats{kind}", lambda i: row[i])
            listed[name] = F.sort_array(taken) if way == "id" else taken
    return made.select(*spaces.columns, "part", *[c.alias(name) for name, c in listed.items()])


def bundle_json(bundle: DataFrame) -> DataFrame:
    """The part of a bundle a model is shown, as JSON text. Items that the bundle has as JSON are taken so."""
    written = [names[2] for names in LISTED]
    if set(written) <= set(bundle.columns):
        lists = [F.concat(F.lit(f',"{names[0]}":['), F.array_join(names[2], ","), F.lit("]")) for names in LISTED]
        return bundle.select("space_id", "part", F.concat(F.lit('{"schema":'), F.to_json("schema"), *lists, F.lit("}")).alias("json"))
    without_id = F.transform("benchmark_results", lambda r: r.dropFields("result_id"))
    shown = F.struct("schema", "instructions", "benchmark_questions", without_id.alias("benchmark_results"))
    return bundle.select("space_id", "part", F.to_json(shown, {"ignoreNullFields": "false"}).alias("json"))


def valid_evidence_ids(instructions: DataFrame, curated: DataFrame, results: DataFrame) -> DataFrame:
    """Ids a step may cite, per space."""
    questions = curated.where(F.col("question_type") == BENCHMARK)
    return (
        instructions.select("space_id", F.col("instruction_id").alias("id"))
        .unionByName(questions.select("space_id", F.col("curated_question_id").alias("id")))
        .unionByName(results.select("space_id", F.col("benchmark_question_id").alias("id")))
        .where(blank_to_null(F.col("id")).isNotNull())
        .distinct()
    )


def ask_model(prompts: DataFrame, model: Callable[[str], str | None], task: str | None = TASK) -> DataFrame:
    """The model's reply to every prompt, which is the task and the evidence below it.

    A call that fails gives a null reply and the error's text, and the other spaces go on. Prompts go to `model`
    one by one inside Arrow batches; the calls dwarf the transfer.
    """
    head = "" if task is None else f"{task}\n\n"

    def answer(texts: pd.Series) -> pd.DataFrame:
        def one(text):
            try:
                return model(head + text), None
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"

        return pd.DataFrame([one(t) for t in texts], columns=["reply", "error"])

    reply = F.pandas_udf(answer, "reply string, error string").asNondeterministic()
    return prompts.withColumn("_answer", reply("json")).select("space_id", "part", "_answer.reply", "_answer.error")


def parse_model_steps(replies: DataFrame) -> DataFrame:
    """Steps in the JSON block of a reply, from its first to its last brace; no steps from anything else.

    The block is read as the only element of a list, which is how text after the JSON gets noticed.
    """
    block = F.regexp_extract(F.coalesce("reply", F.lit("")), r"(?s)\{.*\}", 0)
    listed = F.from_json(F.concat(F.lit("["), block, F.lit("]")), _STEPS_TYPE, {"allowSingleQuotes": "false"})
    steps = F.when(F.size("_read") == 1, F.try_element_at("_read", F.lit(1)).getField("steps"))
    return (
        replies.select("space_id", "part", listed.alias("_read"))
        .select("space_id", "part", F.posexplode(steps).alias("_pos", "_step"))
        .where(F.col("_step").isNotNull())
        .select("space_id", "part", (F.col("_pos") + 1).alias("emit_pos"), "_step.*")
    )


def grounded_steps(steps: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """Steps of an allowed category whose evidence contains a valid id of the space.

    Not every step is held against every id of its space: the pieces of the evidence that are as long
    as some id are looked up instead, so the work grows with the text. With `strict`, an id inside a
    longer word does not count.
    """
    key = ["space_id", "part", "emit_pos"]
    allowed = steps.where(F.col("category").isin(MODEL_CATEGORIES))
    lengths = ids.groupBy("space_id").agg(F.collect_set(F.length("id")).alias("_lengths"))
    text = F.concat(F.lit(" "), F.col("evidence"), F.lit(" "))

    def starts(n: Column) -> Column:
        last = F.length(text) - n
        places = F.when(last >= 2, F.sequence(F.lit(2), last)).otherwise(F.array().cast("array<int>"))
        if not strict:
            return places
        inside = lambda c: c.rlike("[0-9A-Za-z_]")
        return F.filter(
            places, lambda p: ~inside(F.substring(text, p - 1, 1)) & ~inside(F.substring(text, p + n, 1))
        )

    pieces = F.array_distinct(
        F.flatten(F.transform("_lengths", lambda n: F.transform(starts(n), lambda p: F.substring(text, p, n))))
    )
    cited = (
        allowed.where(F.col("evidence").isNotNull())
        .join(lengths, "space_id")
        .select(*key, F.explode(pieces).alias("id"))
        .join(ids, ["space_id", "id"], "left_semi")
        .select(*key)
        .distinct()
    )
    return allowed.join(cited, key, "left_semi")


def trimmed_bundle(
    spaces: DataFrame, instructions: DataFrame, curated: DataFrame,
    n_instructions: int = 12, n_chars: int = 600, n_questions: int = 4,
) -> DataFrame:
    """A small bundle per space for mutation tests: the first instructions, shortened, and questions.

    Its metrics describe a healthy space, so that only the planted defect is there to be found.
    """
    def first(df: DataFrame, id_column: str, k: int) -> DataFrame:
        number = F.col(id_column).try_cast("bigint")
        return top_k(df, ["space_id"], [number.asc_nulls_last(), F.col(id_column).asc()], k)

    short = instructions.withColumn("content", F.substring(F.coalesce("content", F.lit("")), 1, n_chars))
    listed = first(short, "instruction_id", n_instructions).groupBy("space_id").agg(
        F.sort_array(F.collect_list(F.struct("rk", _instruction().alias("item")))).alias("_i")
    )
    kinds = instructions.groupBy("space_id").agg(
        tally(F.col("instruction_type") == SQL_INSTRUCTION).alias("sql_instructions"),
        tally(F.col("instruction_type") == TEXT_INSTRUCTION).alias("text_instructions"),
    )
    questions = first(curated.where(F.col("question_type") == BENCHMARK), "curated_question_id", n_questions)
    asked = questions.groupBy("space_id").agg(
        F.sort_array(F.collect_list(F.struct("rk", _question().alias("item")))).alias("_q")
    )
    joined = (
        spaces.select("space_id", "title")
        .join(kinds, "space_id", "left").join(listed, "space_id", "left").join(asked, "space_id", "left")
        .na.fill(0, ["sql_instructions", "text_instructions"])
    )
    items = {
        "instructions": F.col("_i.item"),
        "benchmark_questions": F.col("_q.item"),
    }
    joined = joined.withColumns(items)
    joined = joined.withColumns({n: F.coalesce(n, F.array().cast(joined.schema[n].dataType)) for n in items})
    no_results = F.array().cast(
        "array<struct<benchmark_question_id:string,question:string,assessment:string,expected_sql:string,"
        "actual_sql:string>>"
    )
    metrics = F.struct(
        F.size("benchmark_questions").alias("benchmark_questions_defined"), F.lit(1).alias("num_runs"),
        F.lit(100.0).alias("coverage_pct"), F.lit(90.0).alias("benchmark_quality_pct"), "sql_instructions",
        "text_instructions", F.lit(90.0).alias("feedback_positive_pct"), F.lit(0).alias("thumbs_down"),
        F.lit(50).alias("msgs"),
    )
    return joined.select(
        "space_id", "title", F.lit(0).cast("bigint").alias("part"), metrics.alias("metrics"),
        F.create_map().cast(SCHEMA_TYPE).alias("schema"), "instructions", "benchmark_questions",
        no_results.alias("benchmark_results"),
    )
