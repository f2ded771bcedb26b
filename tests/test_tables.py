import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from fleetscore import session
from fleetscore.operators import quality, strict, upsert
from fleetscore.plans import daily, landing, registered
from fleetscore.sources import bronze, ledger, stand_in, versions
from fleetscore.streaming import streams

SF = "/root/testdata/sf0.001"


def at(h, day=10):
    return dt.datetime(2024, 1, day, h, tzinfo=dt.timezone.utc)


def test_rows_without_a_full_key_stay(make, rows):
    target = make("message_details", {"space_id": "a", "conversation_id": "c", "message_id": "1"}, {"space_id": "a", "conversation_id": "c"})
    source = make("message_details", {"space_id": "a", "conversation_id": "c"}, {"space_id": "a", "conversation_id": "c"},
                  {"space_id": "a", "conversation_id": "c", "message_id": "1"})
    keys = ["space_id", "conversation_id", "message_id"]
    merged = upsert.upsert(target, source, keys)
    assert sorted(r["message_id"] or "" for r in rows(merged, "message_id")) == ["", "", "", "1"]
    assert rows(upsert.incomplete_keys(merged, keys)) == [
        {"n_rows": 4, "no_space_id": 0, "no_conversation_id": 0, "no_message_id": 3}]


def test_upsert(make, rows):
    target = make("spaces", {"space_id": "a", "title": "old", "harvested_at": at(1)}, {"space_id": "b", "title": "keep"})
    source = make("spaces", {"space_id": "a", "title": "mid", "harvested_at": at(2)},
                  {"space_id": "a", "title": "new", "harvested_at": at(3)}, {"space_id": "c", "title": "added", "harvested_at": at(1)})
    once = upsert.upsert(target, source, ["space_id"])
    assert [(r["space_id"], r["title"]) for r in rows(once, "space_id", "title")] == [("a", "new"), ("b", "keep"), ("c", "added")]
    assert rows(upsert.upsert(once, source, ["space_id"])) == rows(once)
    part = upsert.upsert(target, source, ["space_id"], cols=["harvested_at"])
    assert [(r["space_id"], r["title"]) for r in rows(part, "space_id", "title")] == [("a", "old"), ("b", "keep"), ("c", None)]


def _dated(make, *messages):
    return make("message_details", *messages).withColumn("created_date", F.to_date("created_ts"))


def _message(i, day, status, h):
    return {"space_id": "s", "conversation_id": "c", "message_id": i, "status": status,
            "created_ts": at(1, day) if day else None, "harvested_at": at(h)}


def test_merge_partitions(spark, make, rows, tmp_path):
    path, m = str(tmp_path / "t"), _message
    merge = lambda *r: bronze.merge_partitions(_dated(make, *r), path, streams.MESSAGE_KEYS)
    files = lambda day: {f.rsplit("/", 2)[-2] + f.rsplit("/", 1)[-1] for f in bronze.read_merged(spark, path)
                         .where(F.col("created_date") == day).inputFiles() if f"created_date={day}" in f}
    merge(m("1", 1, "A", 1), m("2", 2, "A", 1), m("3", None, "A", 1), m("5", 3, "A", 1))
    before = files("2024-01-01"), files("2024-01-03")
    for _ in range(3):
        merge(m("2", 2, "B", 2), m("4", 2, "B", 2), m("3", None, "B", 2))
    merge(m("2", 2, "late", 1), m("7", 4, "x", 1), m("6", 1, "y", 1))
    got = rows(bronze.read_merged(spark, path), "message_id", "status")
    assert [(r["message_id"], r["status"]) for r in got] == [
        ("1", "A"), ("2", "B"), ("3", "B"), ("4", "B"), ("5", "A"), ("6", "y"), ("7", "x")]
    assert files("2024-01-03") == before[1], "a day that is not touched keeps its files, also between touched ones"
    assert files("2024-01-01") != before[0]
    merge()
    assert bronze.read_merged(spark, path).count() == 7
    assert versions.vacuum(spark, path) == 0, "young folders stay"
    assert versions.vacuum(spark, path, hours=-1) > 0 and len(versions.listed(spark, f"{path}/log")) == 2
    assert rows(bronze.read_merged(spark, path), "message_id", "status") == got


def test_merge_keeps_rows_without_id(spark, make, rows, tmp_path):
    path = str(tmp_path / "t")
    for n in range(2):
        bronze.merge_partitions(_dated(make, _message(None, 1, "A", n), _message(None, 1, "B", n), _message("1", 1, "C", n)),
                                path, streams.MESSAGE_KEYS)
    assert [r["status"] for r in rows(bronze.read_merged(spark, path), "status")] == ["A", "A", "B", "B", "C"]


def test_lost_writer_leaves_the_old_state(spark, make, rows, tmp_path, monkeypatch):
    path, m = str(tmp_path / "t"), _message
    merge = lambda *r: bronze.merge_partitions(_dated(make, *r), path, streams.MESSAGE_KEYS)
    merge(m("1", 1, "A", 1))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", lost)
        with pytest.raises(RuntimeError):
            merge(m("1", 1, "B", 2), m("2", 1, "B", 2))
    assert [r["status"] for r in rows(bronze.read_merged(spark, path), "status")] == ["A"]
    merge(m("1", 1, "B", 2), m("2", 1, "B", 2))
    assert [r["status"] for r in rows(bronze.read_merged(spark, path), "status")] == ["B", "B"]
    assert versions.vacuum(spark, path, hours=-1, keep=1) == 2, "the lost writer's day and the replaced one"


def test_writers_of_different_days_both_land(spark, make, rows, tmp_path, monkeypatch):
    path, m = str(tmp_path / "t"), _message
    merge = lambda *r: bronze.merge_partitions(_dated(make, *r), path, streams.MESSAGE_KEYS)
    merge(m("1", 1, "A", 1), m("2", 2, "A", 1))
    inner, attempts, write = [], [], versions.write_days

    def meanwhile(df, folder, col):
        """While the first writer writes, another one commits."""
        write(df, folder, col)
        attempts.append(1)
        if inner:
            inner.pop()()

    monkeypatch.setattr(versions, "write_days", meanwhile)
    inner.append(lambda: merge(m("2", 2, "B", 2)))
    merge(m("1", 1, "B", 2))
    assert len(attempts) == 2, "another day is no conflict"
    inner.append(lambda: merge(m("3", 1, "C", 3)))
    merge(m("1", 1, "D", 4))
    assert len(attempts) == 5, "the same day is: the merge is done again"
    got = rows(bronze.read_merged(spark, path), "message_id", "status")
    assert [(r["message_id"], r["status"]) for r in got] == [("1", "D"), ("2", "B"), ("3", "C")]
    monkeypatch.setattr(versions, "commit", lambda *_: False)
    with pytest.raises(versions.Conflict):
        merge(m("1", 1, "E", 5))


def test_log_entries_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions._put(spark, path, versions.State(1, {"d=1": "a"}))
    assert not versions._put(spark, path, versions.State(1, {"d=1": "b"}))
    assert versions.published(spark, path) == versions.State(1, {"d=1": "a"})
    assert versions.listed(spark, f"{path}/log") == [".0000000001.crc", "0000000001"] or versions.listed(spark, f"{path}/log") == ["0000000001"]


def test_exact_percentile_of_many_values(spark):
    """More values in a group than a digest would keep, each of them different."""
    from fleetscore.functions.columns import p90

    n = 400_003
    df = spark.range(n).select(((F.col("id") * 7919) % n / 37).alias("v"))
    exact = sorted(i / 37 for i in range(n))[-(-9 * n // 10) - 1]
    assert df.agg(p90("v").alias("p")).first()["p"] == round(exact, 1)


def test_replace_day_and_export(spark, rows, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 1, 2))], "n int, snapshot_date date")
    bronze.replace_day(df, path)
    bronze.replace_day(df.where("n = 2").withColumn("n", F.lit(9)), path)
    bronze.replace_day(df.where("n = 2").withColumn("n", F.lit(9)), path)
    assert [r["n"] for r in rows(bronze.read_merged(spark, path), "n")] == [1, 9]
    twice = df.union(df.where("n = 1")).withColumnRenamed("n", "k")
    assert rows(bronze.export_snapshot(twice, str(tmp_path / "out"), ["k"])) == [{"k": 1, "n": 2}]


def test_catalog_tables(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS fs_test")
    name = "fs_test.things"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    bronze.create_table(spark, name, "a int, b string")
    bronze.create_table(spark, name, "a int")
    assert spark.table(name).columns == ["a", "b"]
    bronze.overwrite(spark.range(3), name)
    assert spark.table(name).columns == ["id"]
    bronze.create_or_replace(spark.range(2), name)
    assert bronze.scan_bronze(spark, "fs_test", "things").count() == 2


def test_expectations(make, rows):
    df = make("message_details", {"space_id": "a"}, {"space_id": None})
    report = quality.expectation_report(df, quality.HAS_SPACE_ID, "m")
    assert rows(report) == [{"table_name": "m", "expectation": "has_space_id", "passed": 1, "failed": 1}]
    watched, watch = quality.observe_expectations(df, quality.HAS_SPACE_ID, "w")
    assert watched.count() == 2 and watch.get == {"rows": 2, "has_space_id": 1}
    assert quality.expectation_report(df.limit(0), quality.HAS_SPACE_ID, "m").first()["passed"] == 0


def test_strict_model(spark, make, rows):
    now = 1706745600000  # 2024-02-01
    runs = make(
        "eval_runs", {"space_id": "a", "eval_run_id": "1", "num_questions": 10, "num_correct": 9, "num_done": 10, "created_timestamp": 1},
        {"space_id": "a", "eval_run_id": "2", "num_questions": 4, "num_correct": 3, "num_needs_review": 2, "num_done": 4,
         "created_timestamp": now - 86400000},
        {"space_id": "b", "eval_run_id": "3", "num_questions": 2, "num_correct": 1, "num_done": 0, "created_timestamp": None},
        {"space_id": "c", "eval_run_id": "4", "num_questions": 2, "num_correct": 2, "created_timestamp": None},
        {"space_id": "d", "eval_run_id": "5"})
    model = strict.strict_benchmark(runs)
    got = {r["space_id"]: r for r in rows(strict.benchmark_confidence(model, "2024-02-01"))}
    a = got["a"]
    assert (a["accuracy_pct"], a["coverage_pct"], a["full_benchmark_size"], a["num_failed"], a["confidence"]) == (30.0, 100.0, 10, 0, "low")
    # Here a done of 0 stays 0, and only a missing one means the whole run.
    assert (got["b"]["coverage_pct"], got["c"]["coverage_pct"], got["d"]["accuracy_pct"], got["d"]["coverage_pct"]) == (0.0, 100.0, None, 0.0)
    assert got["c"]["confidence"] == "low" and got["c"]["days_since_run"] is None
    kind = {r["space_id"]: r["confidence"] for r in rows(
        strict.benchmark_confidence(model, "2024-02-01", missing_ts_is_stale=False, whole_days=True))}
    assert kind["c"] == "high"


def test_verdicts(spark, rows):
    text = ["GRADE: b | WHY: ok\nthen | FIX: go \n", "grade:A|why:x|fix:", "I cannot say. ", None]
    df = spark.createDataFrame(list(enumerate(text)), "i int, reply string")
    assert [(r["grade"], r["why"], r["fix"]) for r in rows(strict.parse_verdict(df, "reply"), "i", "grade", "why", "fix")] == [
        ("B", "ok\nthen", "go"), ("A", "x", ""), ("?", "I cannot say.", ""), ("?", "", "")]


def test_warehouses_and_gate(spark, make, rows):
    spaces = make("spaces", {"space_id": "dead", "warehouse_id": "gone"}, {"space_id": "ok", "warehouse_id": "w"},
                  {"space_id": "none"}, {"space_id": "blank", "warehouse_id": ""})
    live = spark.createDataFrame([("w",), ("w",)], "warehouse_id string")
    flags = strict.warehouse_missing(spaces, live)
    assert [r["space_id"] for r in rows(flags.where("wh_missing"), "space_id")] == ["dead"]
    used = flags.withColumn("msgs", F.when(F.col("space_id") == "ok", 3))
    assert {r["space_id"]: r["grade"] for r in rows(strict.verdict_gate(used), "space_id", "grade")} == {
        "dead": "F", "ok": None, "none": "—", "blank": "—"}


def test_titles(spark, make, rows):
    spaces = make("spaces", {"space_id": "abcdefghijk", "title": "", "harvested_at": at(1)},
                  {"space_id": "b", "title": "old", "harvested_at": at(1)}, {"space_id": "b", "title": "new", "harvested_at": at(2)},
                  {"space_id": "c", "title": None, "harvested_at": at(1)})
    listed = spark.createDataFrame([("c", "Listed")], "space_id string, title string")
    got = strict.title_fallback(spaces, strict.space_universe(spaces), listed)
    assert [r["title"] for r in rows(got, "space_id", "title")] == ["Space abcdefgh", "new", "Listed"]


def _land_messages(spark, folder, n, messages):
    messages.coalesce(1).write.parquet(f"{folder}/in-{n}")


def _message_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")


def test_streams_equal_batch(spark, rows, tmp_path):
    """Newest files first, an older version of messages after the newer one, and a restart that has lost its checkpoint,
    so that every batch comes again."""
    messages = stand_in.messages_from(stand_in.table(spark, SF, "events"))
    early, late = messages.where("created_ts < '2024-01-15'"), messages.where("created_ts >= '2024-01-15'")
    stale = early.withColumn("status", F.lit("EXECUTING_QUERY")).withColumn("harvested_at", F.lit(None).cast("timestamp"))
    for n, part in enumerate((late, early, stale)):
        _land_messages(spark, tmp_path, n, part)
    stream = lambda: _message_stream(spark, tmp_path, messages.schema)
    rollup, trend = str(tmp_path / "rollup"), str(tmp_path / "daily")
    cols = ["space_id", "message_id", "status", "created_ts", "feedback_rating"]

    from fleetscore.operators.trends import daily_trends
    from fleetscore.sources.payloads import conversation_rollup

    wanted = daily_trends(messages, stand_in.conversations_from(messages)).where("messages > 0")
    for attempt in range(2):
        streams.stream_conversation_rollup(stream(), f"{rollup}-m", rollup, f"{rollup}-state{attempt}").awaitTermination()
        assert rows(bronze.read_merged(spark, rollup).drop("bucket")) == rows(conversation_rollup(messages))
        assert rows(bronze.read_merged(spark, f"{rollup}-m"), *cols) == rows(messages, *cols)
        streams.stream_daily_trend(stream(), f"{trend}-m", trend, f"{trend}-state{attempt}").awaitTermination()
        figures = ["space_id", "date", "messages", "users", "feedback_pos", "feedback_neg"]
        assert rows(bronze.read_merged(spark, trend), *figures) == rows(wanted, *figures)


def some_space(names):
    return sorted(names)[0]


def test_landing(spark, rows, tmp_path):
    """A harvest landed twice changes nothing, gold tables follow from it, and scope is that of the listed spaces."""
    t = lambda name: stand_in.table(spark, SF, name)
    ids = stand_in.messages_from(t("events")).select("space_id").distinct().where("space_id <> 'sp3'")
    spaces = ids.select(F.to_json(F.struct("space_id", F.lit("t").alias("title"))).alias("payload"))
    results, result_details = stand_in.result_payloads(stand_in.Bronze(spark, SF)["eval_results"])
    documents = {
        "spaces": spaces, "space_details": spaces, "space_meta": stand_in.meta_payloads(t("supplier")),
        "instructions": stand_in.instruction_payloads(t("documents"), t("labels")),
        "curated_questions": stand_in.curated_payloads(t("part")),
        "eval_runs": stand_in.eval_run_payloads(t("orders"), t("lineitem")), "eval_results": results,
        "eval_result_details": result_details, "conversations": stand_in.message_payloads(t("events")),
    }
    landed, base, gold = (str(tmp_path / x) for x in ("landed", "bronze", "gold"))
    for kind, pages in documents.items():
        pages.select("payload").write.text(f"{landed}/{kind}")
    state = []
    for _ in range(2):
        tables = landing.run_landed(spark, landed, base, gold, "2024-02-01")
        stored = landing.bronze_tables(spark, base)
        state.append([rows(stored[n]) for n in ("message_details", "conversations")] + [rows(tables["factors"])])
    assert state[0] == state[1] and state[0][0] and state[0][2]
    got = {r["space_id"] for r in state[0][0]}
    assert got == {r["space_id"] for r in state[0][1]} and got <= {r["space_id"] for r in rows(ids)} and "sp3" not in got
    # What came second read nothing; a day that comes later is read alone and touches itself alone.
    assert ledger.new_files(spark, f"{landed}/conversations", "conversations", f"{base}/ledger").count() == 0
    before = {n: versions.published(spark, f"{gold}/states/{n}").partitions for n in ("sums", "users", "latency")}
    page = {"space_id": some_space(got), "conversation": {"id": "new-c"}, "messages": [{
        "message_id": "new-m", "status": "FAILED", "created_timestamp": 1704240000000, "user_id": 77}]}
    (tmp_path / "landed" / "conversations" / "later.txt").write_text(json.dumps(page) + "\n{broken\n")
    fresh = ledger.new_files(spark, f"{landed}/conversations", "conversations", f"{base}/ledger")
    assert [p.rsplit("/", 1)[-1] for p in ledger.read_files(spark, fresh).select("payload").inputFiles()] == ["later.txt"]
    tables = landing.run_landed(spark, landed, base, gold, "2024-02-01")
    for n, old in before.items():
        now = versions.published(spark, f"{gold}/states/{n}").partitions
        assert {d for d in now if now[d] != old.get(d)} <= {"created_date=2024-01-03"}, n
    stored = landing.bronze_tables(spark, base)
    assert stored["message_details"].count() == len(state[0][0]) + 1
    from fleetscore.operators import factors, trends

    assert rows(tables["factors"]) == rows(factors.factors(stored["message_details"], "2024-02-01"))
    assert rows(tables["daily_trends"]) == rows(trends.daily_trends(stored["message_details"], stored["conversations"]))
    assert rows(tables["feedback_flags"]) == rows(factors.feedback_flags(stored["message_details"]))
    # The broken line is set aside until its file is repaired.
    dead = lambda: rows(ledger.open_quarantine(spark, f"{base}/quarantine", f"{base}/ledger"), "kind", "payload")
    assert dead() == [{"kind": "conversations", "payload": "{broken"}]
    page["conversation"]["id"], page["messages"][0]["message_id"] = "repaired-c", "repaired-m"
    (tmp_path / "landed" / "conversations" / "later.txt").write_text(json.dumps(page) + "\n")
    landing.land(spark, landed, base, "2024-02-01")
    assert dead() == [] and landing.bronze_tables(spark, base)["message_details"].count() == len(state[0][0]) + 2
    # Spaces that a harvest doesn't list stay, and so does what is stored of them; a space listed empty has nothing.
    (tmp_path / "landed" / "instructions" / "empty.txt").write_text(json.dumps({"space_id": some_space(got), "instructions": []}) + "\n")
    spaces_before = stored["spaces"].count()
    landing.land(spark, landed, base, "2024-02-01")
    after = landing.bronze_tables(spark, base)
    assert after["spaces"].count() == spaces_before
    assert rows(after["instructions"]) == rows(stored["instructions"].where(F.col("space_id") != some_space(got)))
    some = some_space(got)
    landing.land(spark, landed, str(tmp_path / "one"), "2024-02-01", some)
    one = landing.bronze_tables(spark, str(tmp_path / "one"))
    assert {r["space_id"] for n in ("spaces", "instructions", "eval_runs") for r in rows(one[n], "space_id")} <= {some}


def test_daily_run(spark, tmp_path):
    tables = stand_in.Bronze(spark, SF)
    base = str(tmp_path / "gold")
    asked = lambda text: '{"steps":[{"category":"BAD_GROUND_TRUTH","step":"a","why":"b","evidence":"id 1"}]}'
    for _ in range(2):
        gold = daily.run_daily(spark, tables, base, "2024-02-01", asked)
    assert gold["space_scorecard"].count() == 25
    assert bronze.read_merged(spark, f"{base}/scorecard_history").count() == 25
    assert gold["space_improvements"].where("source = 'agent'").count() > 0
    from fleetscore.schemas import PRIMARY_KEYS

    for name in ("space_scorecard", "space_improvements", "fleet_rollup", "benchmark_run_trend", "feedback_flags"):
        assert quality.key_violations(gold[name], PRIMARY_KEYS[name]).count() == 0, name


def _page(conversation, updated, offset, *message_ids, status="COMPLETED"):
    messages = [{"message_id": m, "status": status, "created_timestamp": 1704067200000} for m in message_ids]
    return (json.dumps({"space_id": "s", "conversation": {"conversation_id": conversation, "last_updated_timestamp": updated},
                        "offset": offset, "messages": messages}),)


def test_messages_on_changed_first_pages_need_no_lookup(spark, rows, tmp_path, monkeypatch):
    """Rows of pages that show a changed conversation themselves go straight to the merge."""
    def refuse(*_):
        raise AssertionError("messages were joined with the conversations of their own pages")

    monkeypatch.setattr(landing, "same_keys", refuse)
    raw = spark.createDataFrame([_page("a", None, 0, "1", "2"), _page("a", None, 0, "2"), _page("b", None, 0)], "payload string")
    days = landing.land_conversations(spark, raw, str(tmp_path), "2024-01-05")
    assert len(days["message_details"]) == 1
    assert [r["message_id"] for r in rows(bronze.read_merged(spark, f"{tmp_path}/message_details"), "message_id")] == ["1", "2"]
    found = rows(bronze.read_merged(spark, f"{tmp_path}/conversations"), "conversation_id", "message_count")
    assert [(r["conversation_id"], r["message_count"]) for r in found] == [("a", 2), ("b", 0)]


def test_messages_on_later_pages_go_with_their_conversation(spark, rows, tmp_path):
    day = lambda n: 1704067200000 + n * 86400000
    first = spark.createDataFrame([_page("a", day(0), 0, "1")], "payload string")
    landing.land_conversations(spark, first, str(tmp_path), "2024-01-05")
    again = spark.createDataFrame([
        _page("a", day(1), 0, "1", status="FAILED"), _page("a", day(1), 1, "9"),  # not changed since the harvest
        _page("b", day(6), 0, "3"), _page("b", None, 1, "4"), _page("c", None, 1, "5"), _page("b", day(6), 0, "3"), ("{",)], "payload string")
    landing.land_conversations(spark, again, str(tmp_path), "2024-01-07")
    found = rows(bronze.read_merged(spark, f"{tmp_path}/message_details"), "conversation_id", "message_id", "status")
    assert [tuple(r.values()) for r in found] == [("a", "1", "COMPLETED"), ("b", "3", "COMPLETED"), ("b", "4", "COMPLETED")]
    found = rows(bronze.read_merged(spark, f"{tmp_path}/conversations"), "conversation_id", "message_count")
    assert [tuple(r.values()) for r in found] == [("a", 1), ("b", 2)]


def test_merge_in_slices_gives_the_same_rows(spark, make, rows, tmp_path):
    """Slices go by the hash of a key, so repeats, stored rows, rows on another day and rows without id meet as in one pass."""
    m = _message
    landings = (
        [m(str(i), i % 3 + 1, "A", 1) for i in range(12)] + [m(None, 1, "A", 1), m("0", 1, "B", 2), m("1", 3, "moved", 2)],
        [m(str(i), i % 3 + 1, "late", 0) for i in range(6)] + [m(str(i), i % 3 + 1, "new", 3) for i in range(4, 20)] + [m(None, 1, "C", 1)])
    got = []
    for n, slice_rows in enumerate((1_000, 3)):
        for landed in landings:
            bronze.merge_partitions(_dated(make, *landed), f"{tmp_path}/{n}", streams.MESSAGE_KEYS, slice_rows=slice_rows)
        got.append(rows(bronze.read_merged(spark, f"{tmp_path}/{n}"), "message_id", "status", "created_date"))
        assert len(versions.listed(spark, f"{tmp_path}/{n}/log")) == 2, "a merge is one commit"
    assert got[0] == got[1] and len(got[0]) == 22


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_stored_tables_leave_no_shuffles(spark, make, tmp_path):
    before = _shuffle_files(spark)
    stored = session.with_known_size(spark.range(100).repartition(3).groupBy("id").count(), "counted")
    assert stored.count() == 100
    versions.write_days(_dated(make, *[_message(str(i), 1, "A", 1) for i in range(9)]).repartition(3, "message_id"), str(tmp_path), "created_date")
    left = {name.rsplit("_", 2)[0] for name in _shuffle_files(spark) - before if name.endswith(".data")}
    assert len(left) <= 1, "that of the count"
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_landing_removes_the_rows_it_has_parsed(spark, tmp_path):
    raw = spark.createDataFrame([_page("a", None, 0, "1", "2")], "payload string")
    scratch = lambda: {n for n in versions.listed(spark, session.ensure_checkpoint_dir(spark)) if n.startswith("pages-")}
    before = scratch()
    landing.land_conversations(spark, raw, str(tmp_path), "2024-01-05")
    assert scratch() == before


def test_landed_documents_are_compressed_in_bounded_files(spark, rows, tmp_path, monkeypatch):
    asked = {}
    monkeypatch.setattr(registered, "scratch_path", lambda _, purpose: asked.setdefault(f"{purpose}-{len(asked)}", f"{tmp_path}/{purpose}-{len(asked)}"))
    events = spark.range(45_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 2) AS ts", "id % 50 AS user_id", "'view' AS event_type",
        "60.0D AS value", """'{"k": 1}' AS props""")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registered._landed_bronze(registered.Fleet(spark, str(tmp_path)))
    assert got.count() == 45_000 and rows(got.groupBy("status", "harvested_at").count(), "status", "count") == [{"status": "COMPLETED", "count": 45_000}]
    late, first = (path for name, path in asked.items() if name.startswith("landed"))
    kept = [n for n in versions.listed(spark, late) if n.startswith("part-")]
    assert len(kept) >= 3 and all(n.endswith(".gz") for n in kept) and not versions.listed(spark, first)
