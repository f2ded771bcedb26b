import datetime as dt
import json

from fleetscore.operators import incremental
from fleetscore.sources import payloads


def land(spark, *documents):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "payload string")


def page(*messages, **fields):
    return {"space_id": "s", "space_title": "S", "conversation": {"conversation_id": "c", "title": "t"},
            "messages": list(messages), **fields}


def one(spark, message):
    return payloads.flatten_messages(land(spark, page(message)), "2024-02-01").first()


def test_message_core(spark):
    m = one(spark, {"id": "i", "message_id": "", "user_id": "12", "created_timestamp": 1000, "last_updated_timestamp": 2500})
    assert (m.message_id, m.user_id, m.response_time_sec) == ("i", 12, 1.5)
    assert m.created_ts.replace(tzinfo=None) == dt.datetime(1970, 1, 1, 0, 0, 1)
    late = one(spark, {"message_id": "m", "created_timestamp": 0, "last_updated_timestamp": 5})
    assert late.created_ts is None and late.response_time_sec is None
    assert (late.attachment_count, late.raw_attachments_json, late.has_query_attachment) == (0, None, False)


def test_attachments(spark):
    m = one(spark, {"message_id": "m", "attachments": [
        {"query": {}}, {"text": {"content": "hi", "id": "t1"}, "extra": {"kept": 1}},
        {"attachment_id": "a2", "query": {"id": "q", "query": "SELECT 1", "statement_id": "s1", "parameters": [],
                                          "query_result_metadata": {"row_count": "7", "is_truncated": "true"}}},
        {"query": {"query": "SELECT 2", "statement_id": "s2"}}, {"suggested_questions": {"questions": ["x", "y"]}}]})
    assert (m.sql_generated, m.sql_attachment_id, m.sql_statement_id) == ("SELECT 1", "a2", "s1")
    assert json.loads(m.sql_statement_ids) == ["s1", "s2"] and m.sql_parameters is None
    assert (m.row_count, m.is_truncated) == (7, True)
    assert (m.text_response, m.text_attachment_id) == ("hi", "t1")
    assert json.loads(m.suggested_questions) == ["x", "y"]
    # Fields nobody declared are still in the raw text.
    assert json.loads(m.raw_attachments_json)[1]["extra"] == {"kept": 1} and m.attachment_count == 5


def test_error_and_feedback(spark):
    m = one(spark, {"message_id": "m", "error": {"type": "T", "error": "e"}, "feedback": {"rating": "POSITIVE"},
                    "query_result": {"statement_id": "l", "row_count": 3}})
    assert (m.error_type, m.error_message, m.feedback_rating) == ("T", "e", "POSITIVE")
    assert (m.legacy_statement_id, m.legacy_row_count, m.legacy_is_truncated) == ("l", 3, None)


def test_pages_and_rollup(spark, rows):
    t = 1704067200000
    raw = land(
        spark,
        page({"message_id": "1", "status": "COMPLETED", "created_timestamp": t + 1000},
             {"message_id": "2", "status": "FAILED", "created_timestamp": t, "error": {"error": "x"}}),
        page({"message_id": "3", "created_timestamp": t + 3000}, offset=2),
        {"space_id": "s", "conversation": {"id": "alone"}, "messages": [{"message_id": "4", "created_timestamp": t}]},
        {"space_id": "s", "conversation": {"id": "silent"}},
        {"space_id": "s", "conversation": {"title": "no id"}, "messages": [{"message_id": "5"}]},
        "not json")
    flat = payloads.flatten_messages(raw)
    assert [(r["message_id"], r["message_position"], r["is_first_message"]) for r in rows(
        flat, "message_id", "message_position", "is_first_message")] == [
        ("1", 1, True), ("2", 2, False), ("3", 3, False), ("4", 1, True)]
    listed = payloads.with_empty_conversations(
        payloads.flatten_conversations(raw), payloads.conversation_rollup(flat), "2024-02-01")
    got = {r["conversation_id"]: r for r in rows(listed)}
    assert set(got) == {"c", "alone", "silent"}
    c = got["c"]
    assert (c["message_count"], c["completed_count"], c["failed_count"], c["conversation_duration_sec"]) == (3, 1, 1, 3.0)
    assert c["has_errors"] and not c["has_feedback"]
    assert got["alone"]["conversation_duration_sec"] is None
    assert (got["silent"]["message_count"], got["silent"]["has_errors"], got["silent"]["first_message_ts"]) == (0, False, None)


def test_objects_count_by_being_there(spark, rows):
    """An error or feedback of fields nobody declared counts; an empty object, null or another type's nothing doesn't."""
    odd = [{"error": {"code": 7}}, {"feedback": {"comment": "good"}}, {"error": {}, "feedback": None}, {"error": {"type": "T", "error": "E"}},
           {"feedback": {"rating": "POSITIVE", "more": [1]}}, {"error": "boom"}, {}]
    raw = land(spark, *[
        {"space_id": "s", "conversation": {"id": str(k)}, "messages": [{"message_id": "m", "created_timestamp": 1, **x}]} for k, x in enumerate(odd)])
    flat = payloads.flatten_messages(raw)
    got = {r["conversation_id"]: r for r in rows(payloads.conversation_rollup(flat))}
    assert [got[str(k)]["has_errors"] for k in range(7)] == [True, False, False, True, False, True, False]
    assert [got[str(k)]["has_feedback"] for k in range(7)] == [False, True, False, False, True, False, False]
    fields = {r["conversation_id"]: (r["error_type"], r["error_message"], r["feedback_rating"]) for r in rows(flat)}
    assert fields["3"] == ("T", "E", None) and fields["4"] == (None, None, "POSITIVE") and fields["5"] == (None, None, None)


def test_pages_landed_twice_count_once(spark, rows):
    t = 1_700_000_000_000
    now = page({"message_id": "1", "status": "COMPLETED", "created_timestamp": t}, {"message_id": "2", "status": "FAILED", "created_timestamp": t + 1})
    before = page({"message_id": "1", "status": "EXECUTING", "created_timestamp": t})
    old, new = (payloads.flatten_messages(land(spark, p, *more), day) for p, more, day in ((before, (), "2024-01-01"), (now, (now,), "2024-02-01")))
    rollup = payloads.conversation_rollup(old.unionByName(new))
    assert [(r["message_count"], r["completed_count"], r["failed_count"]) for r in rows(rollup)] == [(2, 1, 1)]
    raw = land(spark, now, now, before)
    assert payloads.with_empty_conversations(payloads.flatten_conversations(raw), rollup, "2024-02-01").count() == 1


def test_documents_are_parsed_once(spark):
    plan = payloads.flatten_messages(land(spark, page()))._jdf.queryExecution().executedPlan().toString()
    parses = [line for line in plan.splitlines() if "from_json(" in line]
    assert len(parses) == 2, "one for the page and one for the attachments"


def test_spaces(spark, rows):
    listed = land(spark, {"space_id": "a", "title": "A", "description": "short", "warehouse_id": "w"}, {"space_id": "b"})
    detail = land(spark, {"space_id": "a", "title": "other", "description": "", "parent_path": "/p", "warehouse_id": "w2"})
    got = rows(payloads.flatten_spaces(listed, detail), "space_id", "title", "description", "warehouse_id", "parent_path")
    assert got == [
        {"space_id": "a", "title": "A", "description": "short", "warehouse_id": "w2", "parent_path": "/p"},
        {"space_id": "b", "title": "", "description": None, "warehouse_id": None, "parent_path": None}]


def test_owner(spark, rows):
    paths = ["/Workspace/Users/a@b/x", "/Users/old/Users/new/y", "/Shared/z", "", None, "/Users/"]
    raw = land(spark, *[{"space_id": str(i), "parent_path": p} for i, p in enumerate(paths)])
    got = {r["space_id"]: r for r in rows(payloads.flatten_space_meta(raw))}
    assert [got[str(i)]["owner"] for i in range(6)] == ["a@b", "new", "/Shared/z", "unknown", "unknown", ""]
    assert got["0"]["table_identifiers"] == []


def test_curation_and_results(spark, rows):
    runs = payloads.flatten_eval_runs(land(spark, {"space_id": "s", "eval_runs": [
        {"eval_run_id": "2", "num_questions": "7", "num_correct": "n/a", "created_timestamp": 5},
        {"eval_run_id": "10", "num_done": None, "created_timestamp": 5}, {"eval_run_id": "99"}]},
        {"space_id": "none", "eval_runs": []}))
    assert rows(runs.where("eval_run_id = '2'"), "num_questions", "num_correct") == [{"num_questions": 7, "num_correct": None}]
    assert rows(payloads.latest_run_for_results(runs)) == [{"space_id": "s", "eval_run_id": "10"}]
    ins = payloads.flatten_instructions(land(spark, {"space_id": "s", "instructions": [
        {"instruction_id": "1", "use_as_tool": True}, {"instruction_id": "2"}]}))
    assert [r["use_as_tool"] for r in rows(ins, "instruction_id", "use_as_tool")] == ["True", None]
    cq = payloads.flatten_curated_questions(land(spark, {"space_id": "s", "curated_questions": [
        {"curated_question_id": "1", "is_deprecated": "TRUE"}, {"curated_question_id": "2"},
        {"curated_question_id": "3", "is_deprecated": True}, {"curated_question_id": "4", "is_deprecated": False}]}))
    assert [r["is_deprecated"] for r in rows(cq, "curated_question_id", "is_deprecated")] == [True, False, True, False]
    listed = land(spark, {"space_id": "s", "eval_run_id": "1", "eval_results": [{"result_id": "a"}, {"result_id": "b"}]})
    detail = land(spark, {"space_id": "s", "eval_run_id": "1", "result_id": "a", "assessment": "GOOD",
                          "expected_response": "x" * 7000})
    whole = payloads.flatten_eval_results(listed, detail)
    assert max(len(r["expected_response"] or "") for r in rows(whole, "expected_response")) == 7000
    a, b = rows(payloads.flatten_eval_results(listed, detail, chars=6000), "result_id", "assessment", "expected_response", "actual_response")
    assert (len(a["expected_response"]), a["actual_response"]) == (6000, None)
    assert (b["assessment"], b["expected_response"]) == (None, None)


def test_payload_files(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(page({"message_id": "1"})) + "\n" + json.dumps([page({"message_id": "2"})]))
    assert payloads.flatten_messages(payloads.read_payloads(spark, str(tmp_path))).count() == 2


def test_scope(make, rows):
    spaces = make("spaces", {"space_id": "a", "parent_path": "/Users/me/x"}, {"space_id": "b", "parent_path": None},
                  {"space_id": "c", "parent_path": "/Users/you"})
    ids = lambda df: [r["space_id"] for r in rows(df, "space_id")]
    assert incremental.parse_ids(" a, ,b,") == ["a", "b"]
    assert ids(incremental.scope(spaces, "b", "/Users/me")) == ["b"]
    assert ids(incremental.scope(spaces, " , ", "/Users/me")) == ["a"]
    assert ids(incremental.scope(spaces)) == ["a", "b", "c"]
    assert ids(incremental.scope_by_ids(spaces, spaces.where("space_id = 'c'"))) == ["c"]


def test_incremental(make, rows):
    at = lambda h: dt.datetime(2024, 1, 10, h, tzinfo=dt.timezone.utc)
    stored = make("conversations", {"conversation_id": "1", "harvested_at": at(5)}, {"conversation_id": "2", "harvested_at": at(9)})
    cutoff = incremental.incremental_cutoff(stored)
    assert cutoff.first()[0].replace(tzinfo=dt.timezone.utc) == at(7)
    fresh = make("conversations", {"conversation_id": "old", "last_updated_ts": at(6)},
                 {"conversation_id": "edge", "last_updated_ts": at(7)}, {"conversation_id": "unknown"})
    kept = lambda c: [r["conversation_id"] for r in rows(incremental.incremental_filter(fresh, c), "conversation_id")]
    assert kept(cutoff) == ["edge", "unknown"]
    assert len(kept(incremental.incremental_cutoff(stored.limit(0)))) == 3
    assert kept(incremental.incremental_cutoff(None, "2024-01-10 08:30:00")) == ["edge", "unknown"]
