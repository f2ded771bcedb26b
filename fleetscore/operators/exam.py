"""How good the diagnosis is: planted defects, injected defects, recall and precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.functions.columns import TEXT_INSTRUCTION, instant_of
from fleetscore.operators.evidence import SCHEMA_TYPE
from fleetscore.operators.findings import deterministic_findings
from fleetscore.schemas import EXAM_FILE

CONFLICT, BAD_TRUTH = "CONFLICTING_INSTRUCTIONS", "BAD_GROUND_TRUTH"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Exam cases: an evidence bundle each, with what must and must not be found in it."""
    cases = spark.read.schema(EXAM_FILE).option("multiLine", True).json(path)
    return cases.select(F.explode("cases").alias("case")).select("case.*")


def rule_findings_of_cases(cases: DataFrame) -> DataFrame:
    return deterministic_findings(cases.select("case_id", "evidence.metrics.*"), ("case_id",))


def case_scores(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Found, missed and wrongly raised categories of every case; the sets hold a few category names."""
    flagged = findings.groupBy("case_id").agg(F.collect_set("category").alias("flagged"))
    none = F.array().cast("array<string>")
    return (
        cases.select("case_id", F.coalesce("expected.must_flag", none).alias("must"),
                     F.coalesce("expected.must_not_flag", none).alias("must_not"))
        .join(flagged, "case_id", "left")
        .withColumn("flagged", F.coalesce("flagged", none))
        .select(
            "case_id",
            F.size(F.array_intersect("must", "flagged")).alias("n_hit"),
            F.size(F.array_except("must", "flagged")).alias("n_missed"),
            F.size(F.array_intersect("flagged", "must_not")).alias("n_wrong"),
        )
        .withColumn("ok", (F.col("n_missed") == 0) & (F.col("n_wrong") == 0))
    )


def exam_scores(scores: DataFrame) -> DataFrame:
    """Recall and precision over all cases; 1.0 where there was nothing to find or nothing was raised."""
    share = lambda part, rest: F.coalesce(F.try_divide(F.col(part), F.col(part) + F.col(rest)), F.lit(1.0))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return (
        scores.agg(total("n_hit").alias("tp"), total("n_missed").alias("fn"), total("n_wrong").alias("fp"))
        .withColumn("recall", share("tp", "fn"))
        .withColumn("precision", share("tp", "fp"))
    )


def inject_defects(bundles: DataFrame) -> DataFrame:
    """Every bundle twice: once with an instruction that denies another one, once with a wrong expected answer.

    Both defects are made of the bundle's own first instruction and question, so that they look like the rest.
    """
    text = lambda **fields: F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items()])
    rule, asked = F.get("instructions", F.lit(0)), F.get("benchmark_questions", F.lit(0))
    filled = lambda value, otherwise: F.coalesce(value, F.lit(otherwise))
    at_odds = F.array(text(
        instruction_id="defect_rule", instruction_type=TEXT_INSTRUCTION, title=filled(rule["title"], "General"),
        content=F.concat(F.lit("The opposite holds from now on, never this: "), filled(rule["content"], "answer every question"))))
    wrong_sql = F.concat(F.lit("SELECT max(column_nobody_has) FROM ("), filled(asked["answer_text"], "SELECT 1"), F.lit(") t"))
    wording = filled(asked["question_text"], "How many are there?")
    question = F.array(text(benchmark_question_id="defect_question", question_text=wording, answer_text=wrong_sql))
    result = F.array(text(
        benchmark_question_id="defect_question", question=wording, assessment="BAD", expected_sql=wrong_sql,
        actual_sql=filled(asked["answer_text"], "SELECT 1")))
    columns = F.create_map(F.lit("t"), F.array(F.lit("column_of_t"))).cast(SCHEMA_TYPE)
    conflict = F.col("mutation") == "conflict"

    def grown(name, extra, when):
        kept = F.transform(name, lambda x: x.dropFields("result_id")) if "result_id" in str(
            bundles.schema[name].dataType) else F.col(name)
        return F.when(when, F.concat(kept, extra)).otherwise(kept)

    return bundles.withColumn("mutation", F.explode(F.array(F.lit("conflict"), F.lit("bad_truth")))).select(
        "space_id", "mutation", F.when(conflict, CONFLICT).otherwise(BAD_TRUTH).alias("expected"),
        F.struct(
            "title", "metrics",
            F.when(conflict, F.col("schema")).otherwise(columns).alias("schema"),
            grown("instructions", at_odds, conflict).alias("instructions"),
            grown("benchmark_questions", question, ~conflict).alias("benchmark_questions"),
            grown("benchmark_results", result, ~conflict).alias("benchmark_results"),
        ).alias("bundle"),
    )


def mutation_recall(mutated: DataFrame, findings: DataFrame) -> DataFrame:
    """Share of injected defects whose category was raised; findings carry space_id, mutation, category."""
    raised = findings.select("space_id", "mutation", F.col("category").alias("expected")).distinct()
    seen = raised.withColumn("_seen", F.lit(1))
    return (
        mutated.select("space_id", "mutation", "expected")
        .join(seen, ["space_id", "mutation", "expected"], "left")
        .agg(F.count("*").alias("cases"), F.count("_seen").alias("caught"))
        .withColumn(
            "mutation_recall",
            F.coalesce(F.round(F.try_divide(F.col("caught"), F.col("cases")), 3), F.lit(0.0)),
        )
    )


def append_drift_record(recall: DataFrame, path: str, as_of=None) -> None:
    """Keep one line of JSON per exam, for the history of the diagnosis."""
    stamp = F.date_format(instant_of(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")
    recall.select(stamp, "mutation_recall", "cases", "caught").write.mode("append").json(path)
