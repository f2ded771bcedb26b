"""The daily run: bronze to gold to diagnosis, each table written once and read by those that need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetscore.operators import benchmark, evidence, findings, partials, richness, scorecard
from fleetscore.operators import factors as activity
from fleetscore.operators.trends import daily_trends
from fleetscore.sources.bronze import replace_day


def gold_plans(
    bronze: dict[str, DataFrame], as_of=None, kept: Callable[[str, DataFrame], DataFrame] | None = None,
    states: dict[str, DataFrame] | None = None,
):
    """The gold tables by name. `kept` may store a table that several others read, and give it back.

    With day `states`, figures of messages come from these, and messages aren't read.
    """
    keep = kept or (lambda _, df: df)
    messages, runs = bronze["message_details"], bronze["eval_runs"]
    gold = {"factors": keep("factors", partials.factors_of(states, as_of) if states else activity.factors(messages, as_of))}
    gold["richness_facts"] = keep(
        "richness_facts",
        richness.richness_facts(bronze["instructions"], bronze["curated_questions"], bronze["space_meta"]),
    )
    gold["benchmark_facts"] = keep("benchmark_facts", benchmark.benchmark_facts(runs, gold["richness_facts"]))
    gold["space_scorecard"] = keep(
        "space_scorecard",
        scorecard.space_scorecard(
            bronze["space_meta"], gold["factors"], gold["richness_facts"], gold["benchmark_facts"], as_of
        ),
    )
    gold["feedback_flags"] = keep(
        "feedback_flags", states["flags"].drop(partials.DAY) if states else activity.feedback_flags(messages))
    gold["benchmark_runs_monthly"] = keep("benchmark_runs_monthly", benchmark.benchmark_runs_monthly(runs))
    gold["benchmark_run_trend"] = keep(
        "benchmark_run_trend", benchmark.benchmark_run_trend(runs, gold["richness_facts"])
    )
    gold["benchmark_question_matrix"] = keep(
        "benchmark_question_matrix", benchmark.benchmark_question_matrix(bronze["eval_results"], runs)
    )
    gold["daily_trends"] = keep(
        "daily_trends", partials.daily_trends_of(states) if states else daily_trends(messages, bronze["conversations"]))
    gold["fleet_rollup"] = keep("fleet_rollup", scorecard.fleet_rollup(gold["space_scorecard"], as_of))
    return gold


def diagnose(
    bronze: dict[str, DataFrame], scores: DataFrame, model: Callable[[str], str | None] | None = None, as_of=None
) -> DataFrame:
    """Ranked steps for every space: the rules, and what a model adds where it cites real evidence."""
    rules = findings.deterministic_findings(scores)
    if model is None:
        return findings.space_improvements(scores, rules, None, as_of)
    sources = (bronze["instructions"], bronze["curated_questions"], bronze["eval_results"])
    bundles = evidence.evidence_bundle(scores, *sources)
    # A model call is dear: its replies are kept, so that reading them twice does not ask twice.
    replies = evidence.ask_model(evidence.bundle_json(bundles), model).checkpoint()
    grounded = evidence.grounded_steps(
        evidence.parse_model_steps(replies), evidence.valid_evidence_ids(*sources)
    )
    return findings.space_improvements(scores, rules, grounded, as_of)


def run_daily(
    spark: SparkSession, bronze: dict[str, DataFrame], base: str, as_of=None,
    model: Callable[[str], str | None] | None = None, states: dict[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Write all gold tables under `base`; scorecards and rollups are also kept by day (`read_merged` reads these two)."""

    def stored(name: str, df: DataFrame) -> DataFrame:
        path = f"{base}/{name}"
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        # Read back, tables have a known size, so small ones are broadcast and large ones are not.
        return spark.read.parquet(path)

    gold = gold_plans(bronze, as_of, stored, states)
    gold["space_improvements"] = stored(
        "space_improvements", diagnose(bronze, gold["space_scorecard"], model, as_of)
    )
    replace_day(gold["space_scorecard"], f"{base}/scorecard_history")
    replace_day(gold["fleet_rollup"], f"{base}/fleet_history")
    return gold
