import json
import random

from pyspark.sql import functions as F

from fleetscore.operators import evidence, exam, findings, serving

FIGURES = {
    "benchmark_questions_defined": 7, "num_runs": 2, "coverage_pct": 100.0, "benchmark_quality_pct": 80.0, "sql_instructions": 1,
    "text_instructions": 1, "feedback_positive_pct": 50.0, "thumbs_down": 4, "msgs": 31}
# Cases at the edges of the rules: what differs from FIGURES, what must be found, what must not.
EDGES = {
    "at_all_limits": ({}, [], ["LOW_ACCURACY", "NEGATIVE_FEEDBACK", "LOW_COVERAGE", "NO_BENCHMARK"]),
    "just_inaccurate": ({"benchmark_quality_pct": 79.9}, ["LOW_ACCURACY"], ["LOW_COVERAGE"]),
    "inaccurate_but_partial": ({"benchmark_quality_pct": 12.0, "coverage_pct": 99.9}, ["LOW_COVERAGE"], ["LOW_ACCURACY"]),
    "just_disliked": ({"feedback_positive_pct": 49.9}, ["NEGATIVE_FEEDBACK"], []),
    "disliked_by_nobody": ({"feedback_positive_pct": 0.0, "thumbs_down": 0}, [], ["NEGATIVE_FEEDBACK"]),
    "nothing_measured": (dict.fromkeys(FIGURES), ["NO_BENCHMARK", "EMPTY_INSTRUCTIONS"], ["LOW_ACCURACY", "LOW_COVERAGE", "NEGATIVE_FEEDBACK"]),
    "never_run": ({"num_runs": 0, "sql_instructions": 0}, ["NO_BENCHMARK", "NO_SQL_EXAMPLES"], ["EMPTY_INSTRUCTIONS"]),
    "only_examples": ({"text_instructions": 0}, ["EMPTY_INSTRUCTIONS"], ["NO_SQL_EXAMPLES"]),
    "beyond_rules": ({}, ["BAD_GROUND_TRUTH"], ["CONFLICTING_INSTRUCTIONS"]),
}


def test_rules_on_the_exam(spark, rows, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"cases": [
        {"case_id": name, "evidence": {"title": name, "metrics": FIGURES | changed},
         "expected": {"must_flag": must, "must_not_flag": must_not}} for name, (changed, must, must_not) in EDGES.items()]}))
    cases = exam.read_cases(spark, str(path))
    found = exam.rule_findings_of_cases(cases)
    flagged = {name: set() for name in EDGES}
    for r in rows(found, "case_id", "category"):
        flagged[r["case_id"]].add(r["category"])
    for name, (_, must, must_not) in EDGES.items():
        assert set(must) - {"BAD_GROUND_TRUTH"} <= flagged[name] and not flagged[name] & set(must_not), name
    scores = exam.case_scores(cases, found)
    assert {r["case_id"] for r in rows(scores, "case_id", "ok") if not r["ok"]} == {"beyond_rules"}
    total = rows(exam.exam_scores(scores))[0]
    assert (total["tp"], total["fn"], total["fp"], total["precision"]) == (8, 1, 0, 1.0)


def test_exam_of_nothing(spark, rows):
    none = spark.createDataFrame([], "case_id string, n_hit int, n_missed int, n_wrong int")
    assert rows(exam.exam_scores(none), "recall", "precision") == [{"recall": 1.0, "precision": 1.0}]


def scorecard(spark, *cards):
    fields = ("space_id string, title string, owner string, benchmark_questions_defined int, num_runs int, "
              "sql_instructions int, text_instructions int, sample_questions int, coverage_pct double, "
              "benchmark_quality_pct double, feedback_positive_pct double, thumbs_down int, msgs int, benchmark_ran boolean")
    names = [f.split()[0] for f in fields.split(", ")]
    return spark.createDataFrame([tuple(c.get(n) for n in names) for c in cards], fields)


def test_rule_order_and_evidence(spark, rows):
    df = scorecard(spark, {"space_id": "s", "sql_instructions": 2, "coverage_pct": 0.0, "feedback_positive_pct": 40.0,
                           "thumbs_down": 3})
    got = [(r["emit_pos"], r["category"], r["impact"], r["evidence"]) for r in rows(
        findings.deterministic_findings(df), "emit_pos", "category", "impact", "evidence")]
    assert sorted(got) == [
        (1, "NO_BENCHMARK", "high", "benchmark_questions_defined=0, num_runs=0, sql_instructions=2"),
        (2, "EMPTY_INSTRUCTIONS", "medium", "text_instructions=0"),
        (3, "LOW_COVERAGE", "medium", "coverage_pct=0.0"),
        (4, "NEGATIVE_FEEDBACK", "medium", "feedback_positive_pct=40.0, thumbs_down=3")]


def replies(spark, *texts):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "space_id string, part bigint, reply string")


GOOD = '{"steps":[{"category":"BAD_GROUND_TRUTH","step":"x","why":"y","evidence":"see q7","impact":"high"}]}'


def test_model_replies(spark, rows):
    df = replies(spark, GOOD, f"Sure!\n```json\n{GOOD}\n```", '{"steps":[{"cat', None, "nothing", '{"steps":[]}',
                 f"{GOOD} and then {{x}}", "{'steps':[{'category':'A'}]}", '{"steps":[{"category":"A"}]}')
    steps = evidence.parse_model_steps(df)
    assert [r["part"] for r in rows(steps, "part")] == [0, 1, 8]
    last = rows(steps.where("part = 8"))[0]
    assert last["category"] == "A" and last["evidence"] is None and last["emit_pos"] == 1


def test_grounding(spark, rows):
    ids = spark.createDataFrame([("s", "q7"), ("s", "longer-id"), ("t", "b1")], "space_id string, id string")
    steps = spark.createDataFrame(
        [("s", 0, 1, "BAD_GROUND_TRUTH", "see q7."), ("s", 0, 2, "BAD_GROUND_TRUTH", "see q75"),
         ("s", 0, 3, "LOW_ACCURACY", "q7"), ("s", 0, 4, "CONFLICTING_INSTRUCTIONS", "b1"),
         ("s", 0, 5, "CONFLICTING_INSTRUCTIONS", None), ("t", 0, 1, "CONFLICTING_INSTRUCTIONS", "b1"),
         ("s", 0, 6, "CONFLICTING_INSTRUCTIONS", "longer-id"), ("none", 0, 1, "BAD_GROUND_TRUTH", "q7"),
         ("s", 0, 7, "BAD_GROUND_TRUTH", "")],
        "space_id string, part bigint, emit_pos int, category string, evidence string")
    kept = lambda strict: [(r["space_id"], r["emit_pos"]) for r in rows(
        evidence.grounded_steps(steps, ids, strict), "space_id", "emit_pos")]
    # Brute force over all pairs.
    loose = steps.join(ids, "space_id").where(
        F.col("category").isin(evidence.MODEL_CATEGORIES) & F.col("evidence").contains(F.col("id")))
    assert kept(False) == [(r["space_id"], r["emit_pos"]) for r in rows(loose, "space_id", "emit_pos")]
    assert kept(False) == [("s", 1), ("s", 2), ("s", 6), ("t", 1)]
    assert kept(True) == [("s", 1), ("s", 6), ("t", 1)]


def test_improvements_rank(spark, rows):
    cards = scorecard(spark, {"space_id": "s", "title": "S", "sql_instructions": 1, "text_instructions": 0})
    model = spark.createDataFrame(
        [("s", 0, 1, "BAD_GROUND_TRUTH", None, "a", "b", "c"), ("s", 0, 2, "BAD_GROUND_TRUTH", "severe", "a", "b", "c"),
         ("s", 0, 3, "BAD_GROUND_TRUTH", "high", "a", "b", "c"), ("gone", 0, 1, "BAD_GROUND_TRUTH", "high", "a", "b", "c")],
        "space_id string, part bigint, emit_pos int, category string, impact string, step string, why string, evidence string")
    got = findings.space_improvements(cards, findings.deterministic_findings(cards), model, "2024-02-01")
    ranked = sorted((r["rank"], r["impact"], r["source"]) for r in rows(got, "rank", "impact", "source"))
    assert ranked == [(1, "high", "auto"), (2, "high", "agent"), (3, "medium", "auto"), (4, None, "agent"),
                      (5, "severe", "agent")]
    listed = serving.improvement_listing(got)
    assert [(r["impact"], r["pos"]) for r in rows(listed.where("pos > 3"), "impact", "pos")] == [("severe", 5), (None, 4)]


def test_bundle_parts_hold_everything(spark, make, rows):
    cards = scorecard(spark, {"space_id": "big", "title": "Big"}, {"space_id": "empty", "title": "E"})
    ins = make("instructions", *[{"space_id": "big", "instruction_id": str(i), "content": "x" * 10} for i in range(90)])
    curated = make("curated_questions", {"space_id": "big", "curated_question_id": "q", "question_type": "BENCHMARK",
                                         "is_deprecated": True})
    results = make("eval_results", {"space_id": "big", "result_id": "r", "benchmark_question_id": "q"})
    whole = evidence.evidence_bundle(cards, ins, curated, results)
    assert {(r["space_id"], r["part"]) for r in rows(whole, "space_id", "part")} == {("big", 0), ("empty", 0)}
    split = evidence.evidence_bundle(cards, ins, curated, results, part_items=20)
    sizes = [r["n"] for r in rows(split.where("space_id = 'big'"), F.size("instructions").alias("n"))]
    assert sum(sizes) == 90 and len(sizes) == 5 and max(sizes) < 40
    by_text = evidence.evidence_bundle(cards, ins, curated, results, part_chars=300)
    assert by_text.where("space_id = 'big'").count() > 1
    empty = evidence.bundle_json(whole.where("space_id = 'empty'")).first()["json"]
    assert empty == '{"schema":{},"instructions":[],"benchmark_questions":[],"benchmark_results":[]}'
    assert rows(evidence.valid_evidence_ids(ins, curated, results).where("id = 'q'")) == [{"space_id": "big", "id": "q"}]


def test_model_is_asked_and_may_fail(spark, rows):
    prompts = spark.createDataFrame([("a", 0, "fine"), ("b", 0, "boom")], "space_id string, part bigint, json string")

    def model(text):
        if text.endswith("boom"):
            raise RuntimeError("no answer")
        return text.upper()

    assert rows(evidence.ask_model(prompts, model, None), "space_id", "reply", "error") == [
        {"space_id": "a", "reply": "FINE", "error": None}, {"space_id": "b", "reply": None, "error": "RuntimeError: no answer"}]
    asked = evidence.ask_model(prompts.where("space_id = 'a'"), lambda text: text).first()["reply"]
    assert asked == f"{evidence.TASK}\n\nfine"


def test_a_question_its_results_and_rules_of_one_title_share_a_part(spark, make):
    cards = scorecard(spark, {"space_id": "big", "title": "Big"})
    ins = make("instructions", *[
        {"space_id": "big", "instruction_id": f"i{k}", "title": f" Term {k % 300}" if k < 300 else f"term {k % 300}"} for k in range(600)])
    curated = make("curated_questions", *[
        {"space_id": "big", "curated_question_id": f"q{k}", "question_type": "BENCHMARK"} for k in range(600)])
    results = make("eval_results", *[
        {"space_id": "big", "result_id": f"r{k}", "benchmark_question_id": f"q{k}"} for k in range(600)])
    parts = evidence.evidence_bundle(cards, ins, curated, results).collect()
    assert len(parts) > 1
    for p in parts:
        assert {q.benchmark_question_id for q in p.benchmark_questions} == {r.benchmark_question_id for r in p.benchmark_results}
        ids = {i.instruction_id for i in p.instructions}
        assert all(f"i{(int(i[1:]) + 300) % 600}" in ids for i in ids)


def test_mutations(spark, make, rows):
    meta = make("space_meta", {"space_id": "a", "title": "A"})
    ins = make("instructions", *[
        {"space_id": "a", "instruction_id": str(i), "instruction_type": "TEXT_INSTRUCTION", "content": "y" * 900}
        for i in range(15)])
    curated = make("curated_questions", *[
        {"space_id": "a", "curated_question_id": str(i), "question_type": "BENCHMARK"} for i in range(9)])
    small = evidence.trimmed_bundle(meta, ins, curated)
    one = small.first()
    assert [i.instruction_id for i in one.instructions] == [str(i) for i in range(12)]
    assert len(one.instructions[0].content) == 600 and len(one.benchmark_questions) == 4
    assert one.metrics.text_instructions == 15
    mutated = exam.inject_defects(small)
    sizes = {r["mutation"]: (len(r["bundle"]["instructions"]), len(r["bundle"]["benchmark_questions"]),
                             len(r["bundle"]["benchmark_results"])) for r in mutated.collect()}
    assert sizes == {"conflict": (13, 4, 0), "bad_truth": (12, 5, 1)}
    found = spark.createDataFrame([("a", "conflict", "CONFLICTING_INSTRUCTIONS"), ("a", "bad_truth", "LOW_ACCURACY")],
                                  "space_id string, mutation string, category string")
    assert rows(exam.mutation_recall(mutated, found)) == [{"cases": 2, "caught": 1, "mutation_recall": 0.5}]
    assert rows(exam.mutation_recall(mutated.limit(0), found), "mutation_recall") == [{"mutation_recall": 0.0}]


def test_drift_record_is_appended(spark, tmp_path, rows):
    recall = spark.createDataFrame([(2, 1, 0.5)], "cases bigint, caught bigint, mutation_recall double")
    for day in ("2024-01-01", "2024-01-02"):
        exam.append_drift_record(recall, str(tmp_path / "drift"), day)
    kept = rows(spark.read.json(str(tmp_path / "drift")), "ts", "mutation_recall")
    assert [r["ts"][:10] for r in kept] == ["2024-01-01", "2024-01-02"]


def test_bands_and_chips(spark, rows):
    cards = scorecard(
        spark,
        {"space_id": "good", "title": "G", "owner": "o", "benchmark_ran": True, "benchmark_quality_pct": 80.0,
         "benchmark_questions_defined": 1, "sql_instructions": 1, "text_instructions": 1, "sample_questions": 1},
        {"space_id": "low", "title": "L", "owner": "o", "benchmark_ran": True, "benchmark_quality_pct": None,
         "benchmark_questions_defined": 1, "sql_instructions": 0, "text_instructions": 0, "sample_questions": 0},
        {"space_id": "mid", "title": "M", "owner": "", "benchmark_ran": True, "benchmark_quality_pct": 60.0,
         "benchmark_questions_defined": 1, "sql_instructions": 0, "text_instructions": 0, "sample_questions": 0},
        {"space_id": "fix", "title": "F", "owner": "p", "benchmark_ran": True, "benchmark_quality_pct": 95.0,
         "benchmark_questions_defined": 1, "sql_instructions": 0, "text_instructions": 0, "sample_questions": 0},
        {"space_id": "defined", "title": "D", "owner": "p", "benchmark_ran": False, "benchmark_questions_defined": 3,
         "sql_instructions": 0, "text_instructions": 0, "sample_questions": 0},
        {"space_id": "none", "title": "N", "benchmark_ran": False, "benchmark_questions_defined": 0,
         "sql_instructions": 0, "text_instructions": 0, "sample_questions": 0})
    steps = spark.createDataFrame([("fix", "high"), ("fix", "low"), ("mid", "medium")], "space_id string, impact string")
    got = serving.banded(cards, steps)
    assert {r["space_id"]: (r["band"], r["chip"], r["n_recs"]) for r in rows(got, "space_id", "band", "chip", "n_recs")} == {
        "good": ("proven", "PROVEN", 0), "low": ("attention", "LOW ACCURACY", 0), "mid": ("monitor", "MODERATE", 1),
        "fix": ("attention", "NEEDS FIX", 2), "defined": ("monitor", "DEFINED · NOT RUN", 0),
        "none": ("monitor", "NO BENCHMARK", 0)}
    listing = [(r["band_order"], r["pos"], r["space_id"]) for r in serving.band_listing(got).collect()]
    assert sorted(listing) == [(1, 1, "good"), (2, 1, "defined"), (2, 2, "none"), (2, 3, "mid"), (3, 1, "low"), (3, 2, "fix")]
    best = sorted((r["pos"], r["space_id"]) for r in serving.band_listing(got, "benchmarked").collect())
    assert best == [(1, "fix"), (2, "good"), (3, "mid"), (4, "low")]
    assert serving.band_listing(got, "attention", "p").first()["space_id"] == "fix"
    assert [r["owner"] for r in serving.owner_list(cards).collect()] == ["o", "p"]
    kpis = rows(serving.fleet_kpis(got))[0]
    assert (kpis["n"], kpis["proven"], kpis["benchmarked"], kpis["monitor"], kpis["attention"], kpis["avg_quality"]) == (
        6, 1, 4, 3, 2, 78.3)
    assert serving.space_detail(cards, "unknown").count() == 0


def test_coerce(spark, rows):
    df = spark.createDataFrame([(" Yes", "3.7", "x", "a"), ("f", None, "12.5", "b"), (None, "?", None, "c")],
                               "benchmark_ran string, msgs string, score string, title string")
    assert rows(serving.coerce_types(df)) == sorted([
        {"benchmark_ran": True, "msgs": 3, "score": None, "title": "a"},
        {"benchmark_ran": False, "msgs": 0, "score": 12.5, "title": "b"},
        {"benchmark_ran": False, "msgs": 0, "score": None, "title": "c"}], key=repr)


def _met(parts, pairs):
    """How many of the pairs of instruction ids share a part."""
    inside = [{i.instruction_id for i in p.instructions} for p in parts]
    return sum(any(a in ids and b in ids for ids in inside) for a, b in pairs)


def test_untitled_instructions_on_one_term_meet(spark, make):
    cards = scorecard(spark, {"space_id": "big", "title": "Big"})
    ins = make("instructions", *[
        {"space_id": "big", "instruction_id": f"i{k:04d}", "content": f"An item{k % 600} record has always code {k}"} for k in range(1200)])
    parts = evidence.evidence_bundle(cards, ins, make("curated_questions"), make("eval_results")).collect()
    assert _met(parts, [(f"i{k:04d}", f"i{k + 600:04d}") for k in range(600)]) == 600
    assert max(len(p.instructions) for p in parts) <= 1000
    assert {i.instruction_id for p in parts for i in p.instructions} == {f"i{k:04d}" for k in range(1200)}
    assert {p.n_parts for p in parts} == {len(parts)}


def test_the_rule_of_parts_is_the_same_at_every_size(spark, make):
    cards = scorecard(spark, {"space_id": "a", "title": "A"})
    ins = make("instructions", *[
        {"space_id": "a", "instruction_id": f"i{k:02d}", "title": f"T{k}", "content": f"term{k % 7} of {'rare' if k in (3, 22) else 'all'}"} for k in range(30)])
    pairs = [(f"i{a:02d}", f"i{b:02d}") for a in range(30) for b in range(a) if a % 7 == b % 7] + [("i03", "i22")]
    for size in (100, 30, 29, 12, 5):
        parts = evidence.evidence_bundle(cards, ins, make("curated_questions"), make("eval_results"), part_items=size).collect()
        assert max(len(p.instructions) for p in parts) <= 2 * size
        assert _met(parts, pairs) == len(pairs)
        assert (len(parts) == 1) == (size >= 30)


def test_one_title_and_one_question_without_bound(spark, make):
    cards = scorecard(spark, {"space_id": "a", "title": "A"})
    ins = make("instructions", *[{"space_id": "a", "instruction_id": f"i{k}", "title": "Definition", "content": f"c{k}"} for k in range(1200)])
    curated = make("curated_questions", {"space_id": "a", "curated_question_id": "q", "question_type": "BENCHMARK", "question_text": "c7 of c8"})
    results = make("eval_results", *[{"space_id": "a", "result_id": f"r{k}", "benchmark_question_id": "q", "question": "c7 of c8"} for k in range(1100)])
    parts = evidence.evidence_bundle(cards, ins, curated, results).collect()
    assert sum(len(p.benchmark_results) for p in parts) == 1100
    assert all(len(p.instructions) + len(p.benchmark_results) <= 1000 for p in parts) and len(parts) >= 5
    assert all(len(p.benchmark_questions) == 1 for p in parts if p.benchmark_results)
    about = [p for p in parts if p.benchmark_questions and {"i7", "i8"} <= {i.instruction_id for i in p.instructions}]
    assert about or _met(parts, [("i7", "i8")]) == 1
    assert any(p.benchmark_questions and "i7" in {i.instruction_id for i in p.instructions} for p in parts)


def test_names_of_a_part_are_read_without_its_texts(spark, make):
    cards = scorecard(spark, {"space_id": "a", "title": "A"}, {"space_id": "none", "title": "N"})
    ins = make("instructions", *[{"space_id": "a", "instruction_id": None if k == 5 else f"i{k:02d}", "content": f"term{k % 7}"} for k in range(30)])
    curated = make("curated_questions", {"space_id": "a", "curated_question_id": "q", "question_type": "BENCHMARK"})
    results = make("eval_results", *[{"space_id": "a", "result_id": f"r{k}", "benchmark_question_id": "q"} for k in range(3)])
    bundle = evidence.evidence_bundle(cards, ins, curated, results, part_items=8)
    named = bundle.select("space_id", "part", "instruction_ids", "question_ids", "result_ids")
    assert "content" not in named._jdf.queryExecution().executedPlan().toString()
    parts = bundle.collect()
    assert len(parts) > 5
    for p in parts:
        assert p.instruction_ids == [i.instruction_id for i in p.instructions]
        assert p.question_ids == [q.benchmark_question_id for q in p.benchmark_questions]
        assert sorted(p.result_ids) == sorted(r.result_id for r in p.benchmark_results)


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_items_move_once_not_to_each_part_of_their_terms(spark, make, monkeypatch):
    """60 terms bring ten of 40 long instructions together each, so a part's texts are many times those of all items."""
    monkeypatch.setattr(evidence, "TASK_PARTS", 7)
    noise = random.Random(3)
    users = [noise.sample(range(40), 10) for _ in range(60)]
    words = {k: " ".join(f"shared{t}" for t in range(60) if k in users[t]) for k in range(40)}
    cards = scorecard(spark, {"space_id": "s", "title": "S"}, {"space_id": "bare", "title": "B"})
    ins = make("instructions", *[
        {"space_id": "s", "instruction_id": f"i{k}", "title": f"t{k}", "content": f'"{words[k]}" {noise.randbytes(10_000).hex()}'} for k in range(40)])
    curated, results = make("curated_questions"), make("eval_results")
    before = _shuffled(spark)
    got = evidence.bundle_json(evidence.evidence_bundle(cards, ins, curated, results, part_items=10)).collect()
    moved = sum(size for name, size in _shuffled(spark).items() if name not in before)
    texts = {json.dumps(i): i for r in got for i in json.loads(r.json)["instructions"]}
    copies = sum(len(json.loads(r.json)["instructions"]) for r in got)
    assert len(texts) == 40 and copies > 300 and {r.space_id for r in got} == {"s", "bare"}
    assert moved < 40 * 20_000 * 4, "about what the items have, moved to their uid and to their shelf"


def test_parts_made_from_shelves_hold_what_the_structs_hold(spark, make, rows, monkeypatch):
    cards = scorecard(spark, *[{"space_id": s, "title": s} for s in ("a", "b", "bare")])
    ins = make("instructions", *[
        {"space_id": s, "instruction_id": f"i{k % 11}" if k else None, "title": None if k % 5 == 0 else f"T{k % 4}", "content": f'x{k % 7} "y{k % 3}"\né'}
        for s in ("a", "b") for k in range(25)], {"space_id": None, "instruction_id": "lost"}, {"space_id": "gone", "instruction_id": "g"})
    curated = make("curated_questions", *[
        {"space_id": "a", "curated_question_id": f"q{k}", "question_type": "BENCHMARK", "question_text": f"x{k} z"} for k in range(6)])
    results = make("eval_results", *[
        {"space_id": "a", "result_id": f"r{20 - k}", "benchmark_question_id": f"q{k % 6}", "question": None, "actual_response": "s"} for k in range(13)])
    seen = []
    for task_parts, sizes in ((48, {}), (2, {"shelf_parts": 3}), (1, {"shelf_chars": 40})):
        monkeypatch.setattr(evidence, "TASK_PARTS", task_parts)
        bundle = evidence.evidence_bundle(cards, ins, curated, results, part_items=5, **sizes)
        plain = bundle.drop(*[names[2] for names in evidence.LISTED])
        assert rows(evidence.bundle_json(bundle)) == rows(evidence.bundle_json(plain))
        seen.append(rows(plain))
        for r in seen[-1]:
            assert r["instruction_ids"] == [i.instruction_id for i in r["instructions"]] and r["instructions"] == sorted(
                r["instructions"], key=lambda i: [(v is not None, v or "") for v in i])
            assert r["result_ids"] == sorted(x.result_id for x in r["benchmark_results"])
    assert seen[0] == seen[1] == seen[2] and len({(r["space_id"], r["part"]) for r in seen[0]}) == len(seen[0]) > 15
    assert sum(r["space_id"] == "bare" and r["n_parts"] == 1 for r in seen[0]) == 1
