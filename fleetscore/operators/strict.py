"""The strict benchmark model: accuracy against the largest set ever run, with letter-grade verdicts.

Its denominators differ from the scorecard's on purpose, so the two are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import (
    blank_to_null, date_of, epoch_ms_to_ts, grade_score, instant_of, percent, run_recency,
)
from fleetscore.operators.ranking import ordered_rank, top_k

_DAY_MS = 86_400_000
# What a verdict says when no model is asked.
DEAD_WAREHOUSE = ("F", "SQL warehouse deleted — space is non-functional",
                  "Reassign an existing SQL warehouse in space Settings")
NO_ACTIVITY = ("—", "No activity harvested yet — nothing to judge.", "Drive usage or run an eval benchmark.")
# Fixed value: the reply format a verdict is read from.
VERDICT_PATTERN = r"(?is)GRADE:\s*([A-F])\s*\|\s*WHY:\s*(.*?)\s*\|\s*FIX:\s*(.*)"


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def space_universe(spaces: DataFrame) -> DataFrame:
    """The newest harvested version of every space."""
    newest = [F.col("harvested_at").desc_nulls_last(), F.col("title").asc_nulls_last()]
    return top_k(spaces, ["space_id"], newest, 1, "_rk").select("space_id", "title", "warehouse_id")


def title_fallback(ids: DataFrame, universe: DataFrame, fallback: DataFrame) -> DataFrame:
    """A title for every id: its own, else the listed one, else 'Space ' and the start of the id."""
    made_up = F.concat(F.lit("Space "), F.substring("space_id", 1, 8))
    listed = fallback.select("space_id", F.col("title").alias("_listed"))
    return (
        ids.select("space_id").distinct()
        .join(universe, "space_id", "left")
        .join(listed, "space_id", "left")
        .select("space_id", F.coalesce(blank_to_null(F.col("title")), "_listed", made_up).alias("title"),
                "warehouse_id")
    )


def strict_benchmark(runs: DataFrame) -> DataFrame:
    """One row per space with a run: latest run against the largest run."""
    latest = F.max_by(
        F.struct("num_questions", "num_correct", "num_needs_review", "num_done",
                 F.nullif("created_timestamp", F.lit(0)).alias("latest_run_ts")),
        run_recency(),
    )
    done = F.coalesce("num_done", "num_questions", F.lit(0))
    return (
        runs.groupBy("space_id")
        .agg(F.count("*").alias("num_runs"), F.max(_zero(F.col("num_questions"))).alias("full_benchmark_size"),
             latest.alias("latest"))
        .select("space_id", "num_runs", "full_benchmark_size", "latest.*")
        .withColumn("num_done", done)
        .na.fill(0, ["num_questions", "num_correct", "num_needs_review"])
        .select(
            "space_id", F.lit(True).alias("benchmark_ran"), "num_runs",
            percent(F.col("num_correct"), F.col("full_benchmark_size")).alias("accuracy_pct"),
            F.coalesce(percent(F.col("num_done"), F.col("num_questions")), F.lit(0.0)).alias("coverage_pct"),
            "full_benchmark_size", "num_questions", "num_correct", "num_needs_review", "num_done",
            F.greatest(F.col("num_done") - F.col("num_correct") - F.col("num_needs_review"), F.lit(0))
            .alias("num_failed"),
            "latest_run_ts",
        )
    )


def benchmark_confidence(
    strict: DataFrame, as_of=None, stale_days: int = 30, missing_ts_is_stale: bool = True, whole_days: bool = False
) -> DataFrame:
    """High confidence needs a full, complete and recent run.

    By default age is counted in fractions of days and a run without a time is stale; the other mode
    counts whole days and gives such a run the benefit of the doubt.
    """
    age = (F.unix_millis(instant_of(as_of)) - F.col("latest_run_ts")) / F.lit(_DAY_MS)
    days = F.floor(age).cast("int")
    recent = F.coalesce((days if whole_days else age) <= stale_days, F.lit(not missing_ts_is_stale))
    complete = (F.col("coverage_pct") >= 100) & (F.col("num_questions") >= F.col("full_benchmark_size"))
    return strict.withColumn("days_since_run", days).withColumn(
        "confidence", F.when(complete & recent, "high").otherwise("low")
    )


def benchmark_rows(runs: DataFrame, spaces: DataFrame) -> DataFrame:
    """Every run with accuracy against the largest run of its space."""
    full = runs.groupBy("space_id").agg(F.max(_zero(F.col("num_questions"))).alias("_full"))
    done = F.coalesce("num_done", "num_questions", F.lit(0))
    questions, correct, review = (_zero(F.col(c)) for c in ("num_questions", "num_correct", "num_needs_review"))
    size = F.when(F.col("_full") > 0, F.col("_full")).otherwise(1)
    return (
        runs.join(full, "space_id")
        .join(spaces.select("space_id", "title"), "space_id", "left")
        .select(
            "space_id", "title", F.col("eval_run_id").alias("run_id"),
            epoch_ms_to_ts(F.col("created_timestamp")).alias("run_ts"),
            questions.alias("num_questions"), correct.alias("num_correct"),
            F.greatest(done - correct - review, F.lit(0)).alias("num_failed"),
            review.alias("num_needs_review"),
            F.coalesce(percent(done, questions), F.lit(0.0)).alias("coverage"),
            percent(correct, size).alias("accuracy"),
            F.col("eval_run_status").alias("run_status"),
        )
    )


def warehouse_missing(spaces: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Whether a space names a warehouse that is not there; no name is no reason to worry."""
    live = warehouses.select("warehouse_id").distinct().withColumn("_live", F.lit(True))
    named = blank_to_null(F.col("warehouse_id")).isNotNull()
    return spaces.select("space_id", "warehouse_id").join(live, "warehouse_id", "left").select(
        "space_id", "warehouse_id", (named & F.col("_live").isNull()).alias("wh_missing")
    )


def verdict_gate(df: DataFrame) -> DataFrame:
    """Grade, why and fix where the facts decide; null where a model is to be asked."""
    for i, name in enumerate(("grade", "why", "fix")):
        df = df.withColumn(
            name,
            F.when(F.col("wh_missing"), F.lit(DEAD_WAREHOUSE[i]))
            .when(F.coalesce("msgs", F.lit(0)) == 0, F.lit(NO_ACTIVITY[i])),
        )
    return df


def verdict_prompt(df: DataFrame) -> DataFrame:
    """The question put to a model for one space, all its numbers included."""
    accuracy = F.coalesce(F.concat(F.col("accuracy_pct").cast("string"), F.lit("%")), F.lit("NO BENCHMARK RUN"))
    fields = [
        ("questions_asked", F.col("msgs")), ("distinct_users", F.col("users")),
        ("error_rate_pct", F.col("error_pct")), ("p90_latency_sec", F.col("p90_latency_s")),
        ("thumbs_up", F.col("thumbs_up")), ("thumbs_down", F.col("thumbs_down")),
        ("feedback_coverage_pct", F.col("fb_coverage_pct")), ("days_since_last_use", F.col("days_since_active")),
        ("benchmark_accuracy", accuracy), ("benchmark_runs", F.col("num_runs")),
        ("benchmark_coverage_pct", F.col("coverage_pct")),
        ("benchmark_confidence", F.coalesce("confidence", F.lit("n/a"))),
        ("full_benchmark_size", F.col("full_benchmark_size")),
    ]
    facts = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in fields]
    task = F.lit(
        "Judge how far the answers of this data assistant can be trusted. Benchmark accuracy weighs most; "
        "low coverage or confidence means unproven. Answer on one line as "
        "'GRADE: <A-F> | WHY: <=20 words | FIX: <=15 words'. "
    )
    title = F.concat(F.lit('Space="'), F.col("title"), F.lit('"; '))
    return df.select("space_id", F.concat(task, title, F.concat_ws("; ", *facts), F.lit(".")).alias("prompt"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_verdict(df: DataFrame, col: str) -> DataFrame:
    """Add grade, why and fix read from a reply; a reply in another form is kept whole under grade '?'."""
    text = F.coalesce(col, F.lit(""))
    fits = text.rlike(VERDICT_PATTERN)
    grade, why, fix = (F.regexp_extract(text, VERDICT_PATTERN, i) for i in (1, 2, 3))
    return df.select(
        "*",
        F.when(fits, F.upper(grade)).otherwise("?").alias("grade"),
        _stripped(F.when(fits, why).otherwise(text)).alias("why"),
        F.when(fits, _stripped(fix)).otherwise("").alias("fix"),
    )


def scores_snapshot(
    spaces: DataFrame, factors: DataFrame, strict: DataFrame, warehouses: DataFrame,
    replies: DataFrame | None = None, as_of=None, workspace: str = "",
) -> DataFrame:
    """The full score row of every space for one day.

    `strict` is the output of benchmark_confidence; `replies` holds a model's answer per space
    (space_id, reply). Spaces that need an answer and have none are graded '?'.
    """
    counts = ["msgs", "users", "thumbs_up", "thumbs_down", "days_since_active", "num_runs", "full_benchmark_size",
              "num_questions", "num_correct", "num_needs_review", "num_failed"]
    facts = (
        spaces.select("space_id", "title")
        .join(warehouse_missing(spaces, warehouses), "space_id")
        .join(factors.withColumnRenamed("feedback_coverage_pct", "fb_coverage_pct"), "space_id", "left")
        .join(strict, "space_id", "left")
        .na.fill(0, counts)
        .na.fill(0.0, ["error_pct", "p90_latency_s", "fb_coverage_pct"])
        .na.fill(False, ["benchmark_ran"])
    )
    gated = verdict_gate(facts)
    if replies is None:
        answered = gated.withColumn("reply", F.lit(None).cast("string"))
    else:
        answered = gated.join(replies.select("space_id", "reply"), "space_id", "left")
    judged = parse_verdict(answered.withColumnsRenamed({"grade": "_g", "why": "_w", "fix": "_f"}), "reply")
    grade = F.coalesce("_g", "grade")
    longs = {c: F.col(c).cast("bigint") for c in counts}
    return (
        judged.withColumns(longs)
        .withColumns({"grade": grade, "why": F.coalesce("_w", "why"), "fix": F.coalesce("_f", "fix")})
        .select(
            date_of(as_of).alias("snapshot_date"), "space_id", "title", F.lit(workspace).alias("workspace"),
            "warehouse_id", (~F.col("wh_missing")).alias("warehouse_ok"), "grade",
            grade_score(F.col("grade")).alias("score"), F.col("why").alias("verdict_why"),
            F.col("fix").alias("verdict_fix"), "msgs", "users", "error_pct", "p90_latency_s", "thumbs_up",
            "thumbs_down", "fb_coverage_pct", "days_since_active", "benchmark_ran", "num_runs", "accuracy_pct",
            "coverage_pct", "full_benchmark_size", "num_questions", "num_correct", "num_needs_review",
            "num_failed", "confidence", instant_of(as_of).alias("updated_at"),
        )
    )


def cockpit_rank(scores: DataFrame) -> DataFrame:
    """Dead spaces first, then judged, then silent ones; the least accurate first within each."""
    tier = F.when(~F.col("warehouse_ok"), 0).when(F.col("grade") == NO_ACTIVITY[0], 2).otherwise(1)
    order = [F.col("tier").asc(), F.coalesce("accuracy_pct", F.lit(-1.0)).asc(), F.col("space_id").asc()]
    return ordered_rank(scores.withColumn("tier", tier), [], order, "rank")
