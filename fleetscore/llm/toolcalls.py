"""Tool calls and their results in conversations: linking, order, argument checks, canonical JSON.

Events are rows (conv_id, turn, part, kind, role, call_id, name, arguments, content, after): kind is `message`, `call`
or `result`; `after` lists the call ids whose results a call uses.

- A result belongs to the call with its id; if an id occurs several times in a conversation, the n-th result
  belongs to the n-th call. An equi-join on (conversation, id, n) links them.
- Order: an event stays at its own place (turn, part) unless what it needs comes later: a result follows its call,
  and a call follows the results it uses (of the first call with that id). Calls are released level by level, each
  round joining the calls of the last one with those that wait for them, so there are as many rounds as the longest
  chain of calls has links; only calls take part. Calls in a cycle, or behind one, keep their place and get status
  `cyclic`. An `after` id that no call has is ignored.
- Arguments are checked against the JSON schema of the call's name: type, required, properties, additionalProperties,
  enum, minimum, maximum, minLength, maxLength, pattern-free strings, items. A name without a schema, a schema that can't be
  read or applied, arguments that are no JSON or nested too deep for the parser: each is a problem of its row, and such arguments
  stay text. Lone surrogates are written as escapes.
- Every event gets its JSON: sorted keys, no blanks, unescaped Unicode, whole floats as integers.

Null conversations, ids and turns are values like others (null comes first in order), but a null call id links
with nothing. Equal rows follow each other. Null content is JSON null.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscore.llm.arrays import settle
from fleetscore.operators.ranking import ordered_rank, same_keys

ORDER = ["turn", "part"]
ROW = ["conv_id", *ORDER, "kind", "call_id", "_row"]  # an event without its texts, which are put back at the end
TEXTS = ["role", "name", "arguments", "content"]
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}


def canonical(value: object) -> str:
    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        if isinstance(v, float):
            return None if not math.isfinite(v) else int(v) if v.is_integer() and abs(v) < 1e21 else v
        return v

    return _encodable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _encodable(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _fits(value: object, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in TYPES:
        return isinstance(value, TYPES[kind])
    return value is None if kind == "null" else number and (kind == "number" or isinstance(value, int) or value.is_integer())


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What breaks the schema, in order of keys; an empty list if nothing does."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    unknown = [k for k in kinds if k not in (*TYPES, "null", "number", "integer")]
    if unknown:
        return [f"{at}: unknown type {unknown[0]} in schema"]
    if kinds and not any(_fits(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    out = [f"{at}: not one of enum"] if "enum" in schema and value not in schema["enum"] else []
    if number:
        out += [f"{at}: below minimum"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", math.inf) else []
    if isinstance(value, list) and "items" in schema:
        out += [p for k, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{k}]")]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def check_arguments(arguments: str | None, schema: str | None) -> tuple[object, list[str]]:
    """The parsed arguments (their text if they can't be parsed or written again) and their problems."""
    try:
        value = json.loads(arguments) if arguments is not None else None
        canonical(value)
    except ValueError:
        return arguments, ["$: not JSON"]
    except RecursionError:
        return arguments, ["$: nested too deep"]
    if schema is None:
        return value, ["$: no schema"]
    try:
        found = problems(value, json.loads(schema))
    except RecursionError:
        return value, ["$: nested too deep"]
    except (ValueError, TypeError, AttributeError):
        return value, ["$: schema can't be applied"]
    return value, [_encodable(p) for p in found]


_SERIAL = T.StructType([T.StructField("json", T.StringType()), T.StructField("problems", T.ArrayType(T.StringType()))])


@F.pandas_udf(_SERIAL)
def _serialised(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in rows:
        out = []
        for r in frame.itertuples(index=False):
            if r.kind == "call":
                value, found = check_arguments(r.arguments, r.schema)
                event = {"role": r.role, "tool_calls": [{"id": r.call_id, "type": "function", "function": {"name": r.name, "arguments": value}}]}
            else:
                event, found = {"role": r.role, "content": r.content}, []
                if r.kind == "result":
                    event["tool_call_id"] = r.call_id
            out.append((canonical(event), found))
        yield pd.DataFrame(out, columns=["json", "problems"])


def _placed_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, nth, place, level, cyclic): where each call goes, and how many calls it waits for in a row."""
    done_at = results.select("conv_id", "call_id", "nth", F.struct(*ORDER).alias("_result"))
    nodes = calls.withColumn("place", F.struct(*ORDER)).select("conv_id", "call_id", "nth", "place", "after")
    nodes = same_keys(nodes, done_at.dropDuplicates(["conv_id", "call_id", "nth"]), ["conv_id", "call_id", "nth"], "left")
    nodes = settle(nodes.dropDuplicates(["conv_id", "call_id", "nth"]), "calls")
    first = nodes.where("nth = 1").select("conv_id", F.col("call_id").alias("dep"))
    edges = nodes.select("conv_id", "call_id", "nth", F.explode(F.array_distinct("after")).alias("dep"))
    edges = settle(same_keys(edges, first, ["conv_id", "dep"]), "edges")
    keys = ["conv_id", "call_id", "nth"]
    need = edges.groupBy(*keys).agg(F.count("*").alias("need"))
    state = same_keys(nodes.drop("after"), need, keys, "left").select(
        *keys, "place", "_result", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0).alias("level"))
    state = settle(state.withColumn("free", F.col("need") == 0).withColumn("round", F.when(F.col("free"), 0)), "state")
    step = 0
    while not state.where(F.col("round") == step).isEmpty():
        freed = state.where((F.col("round") == step) & (F.col("nth") == 1)).select(
            "conv_id", F.col("call_id").alias("dep"), F.greatest("place", F.coalesce("_result", "place")).alias("p"), F.col("level").alias("l"))
        met = same_keys(edges, freed, ["conv_id", "dep"]).groupBy(*keys).agg(
            F.count("*").alias("_met"), F.max("p").alias("_p"), F.max("l").alias("_l"))
        step += 1
        state = same_keys(state, met, keys, "left").withColumns({
            "need": F.col("need") - F.coalesce("_met", F.lit(0)),
            "place": F.greatest("place", F.coalesce("_p", "place")),
            "level": F.greatest("level", F.coalesce(F.col("_l") + 1, F.lit(0)))}).drop("_met", "_p", "_l")
        state = settle(state.withColumn("round", F.when(~F.col("free") & (F.col("need") == 0), step).otherwise(F.col("round")))
                       .withColumn("free", F.col("need") == 0), "state")
    stuck = ~F.col("free")
    return state.select(*keys, F.when(~stuck, F.col("place")).alias("place"), F.when(stuck, 0).otherwise(F.col("level")).alias("level"), stuck.alias("cyclic"))


def linked(events: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, part, kind, call_id, nth, position (1-based, in topological order), status, problems, json.

    status: `message`, `linked` (call and result found each other), `unanswered`, `orphan` or `cyclic`.
    """
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    whole = events.withColumn("_row", F.xxhash64(*TEXTS))
    own = whole.select(*ROW, "after")
    tools = own.where("kind in ('call', 'result')")
    tools = settle(ordered_rank(tools, ["conv_id", "call_id", "kind"], [*order, F.col("_row")], "nth"), "tools")
    calls, results = tools.where("kind = 'call'"), tools.where("kind = 'result'")
    keys = ["conv_id", "call_id", "nth"]
    placed = settle(_placed_calls(calls.where("call_id is not null"), results.where("call_id is not null")), "placed")
    answered = same_keys(
        calls.where("call_id is not null").select(*keys), results.where("call_id is not null").select(*keys, F.lit(True).alias("_both")), keys)
    tools = same_keys(same_keys(tools, placed, keys, "left"), answered, keys, "left")
    both, call = F.coalesce("_both", F.lit(False)), F.col("kind") == "call"
    status = (F.when(call & F.coalesce("cyclic", F.lit(False)), "cyclic").when(both, "linked")
              .when(call, "unanswered").otherwise("orphan"))
    here = F.struct(*ORDER)
    tools = tools.withColumn("status", status).withColumn("place", F.greatest(here, F.coalesce("place", here))).withColumn(
        "level", F.when(call, F.coalesce("level", F.lit(0)) * 2).otherwise(F.when(both, F.col("level") * 2 + 1).otherwise(0)))
    messages = own.where("kind not in ('call', 'result') or kind is null").withColumns(
        {"nth": F.lit(None).cast("int"), "status": F.lit("message"), "place": here, "level": F.lit(0)})
    columns = [*own.columns, "nth", "status", "place", "level"]
    every = tools.select(*columns).unionByName(messages.select(*columns))
    ranked = ordered_rank(every, ["conv_id"], [F.col("place").asc_nulls_first(), F.col("level"), *order, F.col("kind"), F.col("_row")], "position")
    ranked = same_keys(ranked.drop("after", "place", "level"), whole.select(*ROW, *TEXTS).dropDuplicates(ROW), ROW)
    # The catalogue's size decides how it is joined; of a name listed twice, the least schema counts.
    once = schemas.groupBy(F.col("name").alias("_name")).agg(F.min("schema").alias("schema"))
    ranked = ranked.join(once, F.col("name") == F.col("_name"), "left")
    out = ranked.withColumn("_s", _serialised(F.struct("kind", "role", "call_id", "name", "arguments", "content", "schema")))
    return out.select("conv_id", *ORDER, "kind", "call_id", "nth", "position", "status", F.col("_s.problems").alias("problems"), F.col("_s.json").alias("json"))


ANSWER_SCHEMA = canonical({
    "type": "object", "required": ["question", "turn"], "additionalProperties": False,
    "properties": {"question": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}})


def events_of_conversations(conversations: DataFrame) -> DataFrame:
    """Events of plain chats (conv_id, turn, role, text): a user's turn calls the tool `answer` with the question, the
    assistant's turn right after it is the result, and each question uses the answer to the one before."""
    chat = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    call = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    none = F.lit(None).cast("string")
    parts = F.when(F.col("role") == "user", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = chat.withColumn("part", F.explode(parts))
    is_call, is_result = F.col("part") == 1, F.col("role") == "assistant"
    return rows.select(
        "conv_id", "turn", "part", F.when(is_call, "call").when(is_result, "result").otherwise("message").alias("kind"),
        F.when(is_call, "assistant").when(is_result, "tool").otherwise(F.col("role")).alias("role"),
        F.when(is_call, call).when(is_result, F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string"))).alias("call_id"),
        F.when(is_call, "answer").alias("name"),
        F.when(is_call, F.to_json(F.struct(F.col("text").alias("question"), "turn"))).alias("arguments"),
        F.when(is_call, none).otherwise(F.col("text")).alias("content"),
        F.when(is_call, F.array(F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string")))).otherwise(
            F.array().cast("array<string>")).alias("after"))
