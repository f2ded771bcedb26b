"""Rules that turn a scorecard into improvement steps, and the ranking of all steps of a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import IMPACT_ORDER, instant_of, lookup
from fleetscore.operators.ranking import ordered_rank

# Thresholds of the rules, and who found a step.
LOW_ACCURACY_BELOW, LOW_FEEDBACK_BELOW, FULL_COVERAGE = 80.0, 50.0, 100
RULE_SOURCE, MODEL_SOURCE = "auto", "agent"

ADVICE = {
    "no_benchmark": "Write a handful of benchmark questions from what users ask most, give each a checked SQL "
                    "answer, and run them.",
    "no_benchmark_why": "Without a benchmark that has been run, nobody knows whether the answers are right.",
    "empty": "Start curating: describe the domain, its grain and its terms in text, and add worked SQL examples.",
    "empty_why": "The assistant has nothing to go by and has to guess what tables and columns mean.",
    "no_text": "Describe key terms, the grain of a row and the scope in text instructions.",
    "no_text_why": "There are SQL examples, but no text says what the terms mean.",
    "no_sql": "Add worked SQL examples for the questions asked most.",
    "no_sql_why": "There is text, but no SQL example to follow.",
    "coverage": "Run all benchmark questions, not only some.",
    "coverage_why": "Accuracy is known for a part of the benchmark only.",
    "accuracy": "Look at the failing benchmark questions; correct the instructions or the expected answers.",
    "feedback": "Go through the negative ratings and turn them into instructions or benchmark questions.",
}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _step(when: Column, category: str, impact: str, step: Column | str, why: Column | str, evidence: Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(
        when,
        F.struct(
            F.lit(category).alias("category"), F.lit(impact).alias("impact"), F.lit(RULE_SOURCE).alias("source"),
            as_column(step).alias("step"), as_column(why).alias("why"), evidence.alias("evidence"),
        ),
    )


def rule_steps() -> Column:
    """The array of steps a scorecard row gives rise to, in the order of the rules."""
    count = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    defined, runs, down = count("benchmark_questions_defined"), count("num_runs"), count("thumbs_down")
    sql, text = count("sql_instructions"), count("text_instructions")
    share = lambda name: F.col(name).cast("double")
    coverage, quality, positive = share("coverage_pct"), share("benchmark_quality_pct"), share("feedback_positive_pct")
    define = F.when(
        sql > 0,
        _text(ADVICE["no_benchmark"], " The ", sql, " curated SQL example(s) are a good start."),
    ).otherwise(ADVICE["no_benchmark"])
    steps = F.array(
        _step((defined == 0) | (runs == 0), "NO_BENCHMARK", "high", define, ADVICE["no_benchmark_why"],
              _text("benchmark_questions_defined=", defined, ", num_runs=", runs, ", sql_instructions=", sql)),
        _step((text == 0) & (sql == 0), "EMPTY_INSTRUCTIONS", "high", ADVICE["empty"], ADVICE["empty_why"],
              _text("text_instructions=", text, ", sql_instructions=", sql)),
        _step((text == 0) & (sql > 0), "EMPTY_INSTRUCTIONS", "medium", ADVICE["no_text"], ADVICE["no_text_why"],
              _text("text_instructions=", text)),
        _step((text > 0) & (sql == 0), "NO_SQL_EXAMPLES", "medium", ADVICE["no_sql"], ADVICE["no_sql_why"],
              _text("sql_instructions=", sql)),
        _step(coverage < FULL_COVERAGE, "LOW_COVERAGE", "medium", ADVICE["coverage"], ADVICE["coverage_why"],
              _text("coverage_pct=", coverage)),
        _step((coverage >= FULL_COVERAGE) & (quality < LOW_ACCURACY_BELOW), "LOW_ACCURACY", "high",
              ADVICE["accuracy"], _text("Of the whole benchmark, ", quality, "% is right."),
              _text("benchmark_quality_pct=", quality, ", coverage_pct=", coverage)),
        _step((positive < LOW_FEEDBACK_BELOW) & (down > 0), "NEGATIVE_FEEDBACK", "medium", ADVICE["feedback"],
              _text("Of the ratings, ", positive, "% are positive, with ", down, " thumbs-down."),
              _text("feedback_positive_pct=", positive, ", thumbs_down=", down)),
    )
    return F.filter(steps, lambda s: s.isNotNull())


def deterministic_findings(scorecard: DataFrame, id_columns: tuple[str, ...] = ("space_id",)) -> DataFrame:
    """The steps of every space as rows, numbered in the order of the rules."""
    return (
        scorecard.select(*id_columns, F.posexplode(rule_steps()).alias("_pos", "_step"))
        .select(*id_columns, (F.col("_pos") + 1).alias("emit_pos"), "_step.*")
    )


def space_improvements(
    scorecard: DataFrame, rules: DataFrame, model: DataFrame | None = None, generated_at=None
) -> DataFrame:
    """All steps of the scorecard's spaces, ranked by impact; rules come before the model among equals.

    A step without an impact ranks as low, one with an impact nobody knows comes last.
    """
    cols = ["category", "impact", "source", "step", "why", "evidence"]
    steps = rules.select("space_id", F.lit(0).alias("_by"), F.lit(0).cast("bigint").alias("_part"), "emit_pos", *cols)
    if model is not None:
        answered = model.withColumn("source", F.lit(MODEL_SOURCE))
        steps = steps.unionByName(
            answered.select("space_id", F.lit(1).alias("_by"), F.col("part").cast("bigint").alias("_part"),
                            "emit_pos", *cols)
        )
    weight = F.coalesce(lookup(F.col("impact"), IMPACT_ORDER), F.when(F.col("impact").isNull(), 2).otherwise(3))
    order = [weight.asc(), F.col("_by").asc(), F.col("_part").asc(), F.col("emit_pos").asc()]
    named = steps.join(scorecard.select("space_id", "title"), "space_id")
    return ordered_rank(named, ["space_id"], order, "rank").select(
        "space_id", "title", "rank", *cols, instant_of(generated_at).alias("generated_at")
    )
