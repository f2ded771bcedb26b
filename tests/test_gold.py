import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetscore.operators import benchmark, factors, richness, scorecard, trends
from fleetscore.operators.ranking import ordered_rank, top_k

T0 = dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc)


def message(space="s", **fields):
    return {"space_id": space, "conversation_id": "c", "status": "COMPLETED", "created_ts": T0, "user_id": 1, **fields}


def test_error_is_three_valued(make, rows):
    df = make("message_details", message(message_id="1", status=None), message(message_id="2", status="EXECUTING_QUERY"),
              message(message_id="3", status=None, error_type="X"), message(message_id="4"))
    assert [r["message_id"] for r in rows(factors.error_messages(df), "message_id")] == ["2", "3"]
    one = rows(factors.factors(df, "2024-02-01"))[0]
    assert (one["msgs"], one["users"], one["error_pct"], one["days_since_active"]) == (4, 1, 50.0, 22)


def test_ratings_and_missing_latency(make, rows):
    df = make("message_details", message(feedback_rating="POSITIVE"), message(feedback_rating="NEGATIVE"),
              message(feedback_rating="THUMBS_UP"), message())
    one = rows(factors.factors(df, "2024-02-01"))[0]
    assert (one["thumbs_up"], one["thumbs_down"], one["feedback_coverage_pct"]) == (1, 1, 75.0)
    assert one["p90_latency_s"] is None


def test_rows_without_a_space_are_kept(make, rows):
    df = make("message_details", message(space=None, response_time_sec=2.0), message(space=None))
    assert rows(factors.factors(df), "space_id", "msgs", "p90_latency_s") == [
        {"space_id": None, "msgs": 2, "p90_latency_s": 2.0}]


@pytest.fixture
def fleet(make):
    instructions = make("instructions", {"space_id": "a", "instruction_id": "1", "instruction_type": "SQL_INSTRUCTION",
                                         "instruction_status": "ACCEPTED"})
    curated = make(
        "curated_questions",
        {"space_id": "b", "curated_question_id": "1", "question_type": "BENCHMARK", "is_deprecated": None},
        {"space_id": "b", "curated_question_id": "2", "question_type": "BENCHMARK", "is_deprecated": True},
        {"space_id": "b", "curated_question_id": "3", "question_type": "SAMPLE_QUESTION", "is_deprecated": False})
    meta = make("space_meta", {"space_id": "a", "title": "A", "table_identifiers": ["t"]},
                {"space_id": "b", "title": "B"}, {"space_id": "bare", "title": "Bare"})
    runs = make(
        "eval_runs",
        {"space_id": "a", "eval_run_id": "9", "num_questions": 4, "num_correct": 3, "num_done": 0, "created_timestamp": 5},
        {"space_id": "a", "eval_run_id": "10", "num_questions": 4, "num_correct": 2, "num_done": None,
         "created_timestamp": 5},
        {"space_id": "a", "eval_run_id": "11", "num_questions": 9, "num_correct": 9, "created_timestamp": None},
        {"space_id": "bare", "eval_run_id": "1", "num_questions": 1, "num_correct": 1, "created_timestamp": 5})
    return instructions, curated, meta, runs


def test_richness_and_scorecard(fleet, make, rows):
    instructions, curated, meta, runs = fleet
    rich = richness.richness_facts(instructions, curated, meta)
    found = {r["space_id"]: r for r in rows(rich)}
    assert set(found) == {"a", "b"}
    assert found["b"]["benchmark_questions_defined"] == 1 and found["b"]["sample_questions"] == 1
    assert found["a"]["n_tables"] == 1 and found["b"]["n_tables"] == 0

    bench = benchmark.benchmark_facts(runs, rich)
    facts = {r["space_id"]: r for r in rows(bench)}
    # Equal times go by the number of the run, a missing time is oldest, and done 0 means the whole run.
    assert (facts["a"]["num_correct"], facts["a"]["num_runs"], facts["a"]["benchmark_quality_pct"]) == (2, 3, 50.0)
    assert facts["a"]["coverage_pct"] is None
    # Defined, never run: covered 0 %, quality not measured, no made-up date.
    assert (facts["b"]["coverage_pct"], facts["b"]["benchmark_quality_pct"], facts["b"]["latest_run_ts"]) == (0.0, None, None)

    active = factors.factors(make("message_details", message(space="a")), "2024-02-01")
    cards = {r["space_id"]: r for r in rows(scorecard.space_scorecard(meta, active, rich, bench, "2024-02-01"))}
    assert set(cards) == {"a", "b", "bare"}
    # Runs of a space without curation do not show, and counts are 0 where percentages are null.
    assert cards["bare"]["num_runs"] == 0 and cards["bare"]["benchmark_ran"] is False
    assert cards["bare"]["days_since_active"] == 0 and cards["bare"]["error_pct"] is None
    assert cards["a"]["feedback_positive_pct"] is None


def test_run_trend_and_delta(fleet, rows):
    instructions, curated, meta, runs = fleet
    trend = benchmark.benchmark_run_trend(runs, richness.richness_facts(instructions, curated, meta))
    assert [(r["eval_run_id"], r["run_index"]) for r in rows(trend.where("space_id = 'a'"), "eval_run_id", "run_index")] == [
        ("10", 3), ("11", 1), ("9", 2)]
    delta = {r["space_id"]: r for r in rows(benchmark.trend_delta(trend))}
    assert (delta["a"]["first_pct"], delta["a"]["last_pct"], delta["a"]["delta_pp"], delta["a"]["direction"]) == (
        100.0, 50.0, -50.0, "down")
    assert delta["bare"]["delta_pp"] is None and delta["bare"]["direction"] is None


def test_matrix(make, rows):
    runs = make("eval_runs", {"space_id": "s", "eval_run_id": "1", "created_timestamp": 10},
                {"space_id": "s", "eval_run_id": "2", "created_timestamp": 10},
                {"space_id": "s", "eval_run_id": "3", "created_timestamp": 20},
                {"space_id": "s", "eval_run_id": "4", "created_timestamp": 5})
    long = "q" * 400
    results = make("eval_results", *[
        {"space_id": "s", "eval_run_id": r, "benchmark_question_id": q[0], "question": q, "assessment": a, "result_id": i}
        for r, q, a, i in [("1", "x", "GOOD", "a"), ("2", "x", "BAD", "b"), ("3", long, None, "c"), ("9", "x", "GOOD", "d")]])
    matrix = benchmark.benchmark_question_matrix(results, runs, chars=300)
    whole = benchmark.benchmark_question_matrix(results, runs)
    assert max(len(r["question"]) for r in rows(whole, "question")) == 400
    assert {r["result_id"]: r["run_index"] for r in rows(matrix, "result_id", "run_index")} == {
        "d": 1, "a": 2, "b": 2, "c": 3}
    cells = {(r["benchmark_question_id"], r["eval_run_id"]): r for r in rows(benchmark.matrix_cells(matrix))}
    assert cells[("x", "2")]["glyph"] == "✕" and cells[("q", "3")]["glyph"] == "·" and cells[("x", "1")]["run_index"] == 2
    assert len(cells[("q", "3")]["question"]) == 300 and len(cells[("q", "3")]["label"]) == 61
    assert sum(r["n_results"] for r in cells.values()) == 4
    pivot = {r["benchmark_question_id"]: [tuple(x) for x in r["runs"]] for r in rows(benchmark.matrix_pivot(matrix))}
    assert pivot == {"x": [(1, "9", "GOOD"), (2, "1", "GOOD"), (2, "2", "BAD")], "q": [(3, "3", None)]}


def test_daily_trends_keep_gaps(make, rows):
    messages = make("message_details", message(), message(created_ts=None))
    conversations = make("conversations", {"space_id": "s", "created_ts": T0 + dt.timedelta(days=1)})
    got = rows(trends.daily_trends(messages, conversations), "date", "messages", "conversations", "error_rate")
    assert [(str(r["date"]), r["messages"], r["conversations"], r["error_rate"]) for r in got] == [
        ("2024-01-10", 1, 0, 0.0), ("2024-01-11", 0, 1, None)]


def test_ordered_rank_equals_window(spark):
    """One group holds most rows, as a busy space would; ranks must not depend on how rows are spread."""
    df = spark.range(0, 20000, 1, 7).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None)
        .otherwise((F.col("id") % 5).cast("string")).alias("g"),
        (F.col("id") * 7919 % 20011).alias("v"))
    from pyspark.sql.window import Window

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ordered_rank(df, ["g"], [F.col("v").asc()], "r")
        assert ranked.select(F.spark_partition_id()).distinct().count() > 1
        expected = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("v")))
        off = ranked.join(expected, (ranked.v == expected.v) & ranked.g.eqNullSafe(expected.g)).where("r <> w")
        assert ranked.count() == 20000 and off.count() == 0
        whole = ordered_rank(df, [], [F.col("v").asc()], "r")
        assert whole.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first() == (1, 20000, 20000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_top_k_is_cut_before_the_shuffle(make):
    plan = trends.recent_errors(make("message_details", message()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top_k(make("message_details", message()), ["space_id"], [F.col("message_id").asc()], 3).count() == 1


def test_fleet_figures(spark, rows):
    fresh = spark.createDataFrame([("a", 1), ("b", 9), ("c", 4)], "space_id string, harvest_age_days int")
    rich = spark.createDataFrame([("a", 2), ("b", 5), ("d", 100)], "space_id string, richness_score bigint")
    assert rows(scorecard.fleet_medians(fresh, rich)) == [
        {"median_age_days": 4.0, "pct_fresh": 66.7, "median_richness": 5.0}]
