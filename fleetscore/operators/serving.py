"""What a dashboard shows: bands, chips, KPIs and ordered listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.functions.columns import impact_rank, tally
from fleetscore.operators.ranking import ordered_rank

# Columns that may arrive as text, by the type they are read as.
BOOLEAN_COLUMNS = ["benchmark_ran"]
INTEGER_COLUMNS = [
    "msgs", "users", "days_since_active", "sql_instructions", "text_instructions", "sample_questions",
    "benchmark_questions_defined", "n_tables", "num_runs", "num_questions", "num_correct", "num_needs_review",
    "num_done", "thumbs_up", "thumbs_down", "rank",
]
FLOAT_COLUMNS = [
    "benchmark_quality_pct", "coverage_pct", "feedback_positive_pct", "feedback_coverage_pct", "score",
]
TRUE_WORDS = ["true", "t", "1", "yes"]
BAND_ORDER = {"proven": 1, "monitor": 2, "attention": 3}


def coerce_types(df: DataFrame) -> DataFrame:
    """Typed columns from text: unreadable counts become 0, unreadable percentages null."""
    typed = {}
    for c in df.columns:
        text = F.trim(F.col(c).cast("string"))
        if c in BOOLEAN_COLUMNS:
            typed[c] = F.coalesce(F.lower(text).isin(TRUE_WORDS), F.lit(False))
        elif c in INTEGER_COLUMNS:
            typed[c] = F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
        elif c in FLOAT_COLUMNS:
            typed[c] = text.try_cast("double")
    return df.withColumns(typed)


def recommendation_counts(improvements: DataFrame) -> DataFrame:
    """Steps per space and whether one of them is of high impact."""
    return improvements.groupBy("space_id").agg(
        F.count("*").alias("n_recs"), (F.max((F.col("impact") == "high").cast("int")) == 1).alias("has_high")
    ).na.fill(False, ["has_high"])


def banded(scorecard: DataFrame, improvements: DataFrame) -> DataFrame:
    """The scorecard with its health band, status chip and number of recommendations."""
    ran = F.col("benchmark_ran")
    quality = F.coalesce("benchmark_quality_pct", F.lit(0.0))
    high = F.col("has_high")
    band = F.when(high | (ran & (quality < 50)), "attention").when(ran & (quality >= 80), "proven")
    chip = (
        F.when(ran & (quality < 50), "LOW ACCURACY")
        .when(high, "NEEDS FIX")
        .when(ran & (quality >= 80), "PROVEN")
        .when(ran, "MODERATE")
        .when(F.col("benchmark_questions_defined") > 0, "DEFINED · NOT RUN")
        .otherwise("NO BENCHMARK")
    )
    return (
        scorecard.join(recommendation_counts(improvements), "space_id", "left")
        .na.fill(False, ["has_high"])
        .na.fill(0, ["n_recs"])
        .withColumn("band", band.otherwise("monitor"))
        .withColumn("chip", chip)
    )


def health_band(scorecard: DataFrame, improvements: DataFrame) -> DataFrame:
    return banded(scorecard, improvements).select("space_id", "band")


def status_chip(scorecard: DataFrame, improvements: DataFrame) -> DataFrame:
    return banded(scorecard, improvements).select("space_id", "chip")


def _kpis() -> list:
    return [
        F.count("*").alias("n"),
        tally(F.col("band") == "proven").alias("proven"),
        tally(F.col("benchmark_ran")).alias("benchmarked"),
        tally(F.col("band") == "monitor").alias("monitor"),
        tally(F.col("band") == "attention").alias("attention"),
        F.round(F.avg(F.when(F.col("benchmark_ran"), F.col("benchmark_quality_pct"))), 1).alias("avg_quality"),
    ]


def fleet_kpis(banded_scores: DataFrame) -> DataFrame:
    return banded_scores.agg(*_kpis())


def owner_list(scorecard: DataFrame) -> DataFrame:
    """Owners to choose from."""
    return scorecard.where(F.col("owner") != "").select("owner").distinct().orderBy("owner")


def owner_rollup(banded_scores: DataFrame) -> DataFrame:
    """The KPIs of every owner's spaces."""
    return banded_scores.where(F.col("owner") != "").groupBy("owner").agg(*_kpis())


def worst_first(df: DataFrame) -> DataFrame:
    order = [F.col("benchmark_quality_pct").asc_nulls_first(), F.col("space_id").asc()]
    return ordered_rank(df, [], order, "pos")


def best_first(df: DataFrame) -> DataFrame:
    order = [F.col("benchmark_quality_pct").desc_nulls_last(), F.col("space_id").asc()]
    return ordered_rank(df, [], order, "pos")


def band_listing(banded_scores: DataFrame, filter: str = "all", owner: str = "all") -> DataFrame:
    """The cards of the overview. Proven and benchmarked lists run best first, the others worst first."""
    df = banded_scores if owner == "all" else banded_scores.where(F.col("owner") == owner)
    if filter == "benchmarked":
        df = df.where(F.col("benchmark_ran"))
        group, best = F.lit(1), F.lit(True)
    else:
        if filter in BAND_ORDER:
            df = df.where(F.col("band") == filter)
        group = F.when(F.col("band") == "proven", BAND_ORDER["proven"]).when(
            F.col("band") == "monitor", BAND_ORDER["monitor"]
        ).otherwise(BAND_ORDER["attention"])
        best = F.col("band") == "proven"
    quality = F.col("benchmark_quality_pct")
    cards = df.select(
        group.alias("band_order"), best.alias("_best"), "space_id", "title", "chip", quality.alias("quality"),
        (F.col("sql_instructions") + F.col("text_instructions")).cast("bigint").alias("instr_total"),
        (F.col("sql_instructions") + F.col("text_instructions") + F.col("sample_questions")).cast("bigint")
        .alias("richness_total"),
    )
    unmeasured = F.col("quality").isNull()
    order = [
        F.when(F.col("_best"), unmeasured.cast("int")).otherwise((~unmeasured).cast("int")).asc(),
        F.when(F.col("_best"), -F.col("quality")).otherwise(F.col("quality")).asc_nulls_first(),
        F.col("space_id").asc(),
    ]
    return ordered_rank(cards, ["band_order"], order, "pos").select(
        "band_order", "pos", "space_id", "title", "chip", "quality", "instr_total", "richness_total"
    )


def space_detail(scorecard: DataFrame, space_id: str) -> DataFrame:
    """The scorecard of one space; no row when it is not in scope."""
    return scorecard.where(F.col("space_id") == space_id)


def improvement_listing(improvements: DataFrame) -> DataFrame:
    """Steps of every space, by impact as written and then by rank."""
    order = [impact_rank(F.col("impact")).asc(), F.col("rank").asc()]
    return ordered_rank(improvements, ["space_id"], order, "pos").select(
        "space_id", "pos", "impact", "category", "source", "step", "why", "evidence"
    )
