"""Column expressions shared by the operators. All of them stay inside generated code."""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and numbers the scorecard is defined with.
COMPLETED, FAILED = "COMPLETED", "FAILED"
POSITIVE, NEGATIVE = "POSITIVE", "NEGATIVE"
SQL_INSTRUCTION, TEXT_INSTRUCTION, ACCEPTED = "SQL_INSTRUCTION", "TEXT_INSTRUCTION", "ACCEPTED"
SAMPLE_QUESTION, BENCHMARK = "SAMPLE_QUESTION", "BENCHMARK"
GREEN_FROM, AMBER_FROM = 80, 50
GRADE_SCORES = {"A": 92.0, "B": 80.0, "C": 66.0, "D": 48.0, "F": 22.0}
IMPACT_ORDER = {"high": 0, "medium": 1, "low": 2}
ASSESSMENT_GLYPHS = {"GOOD": "✓", "BAD": "✕", "NEEDS_REVIEW": "~"}
ASSESSMENT_COLOURS = {"GOOD": "green", "BAD": "red", "NEEDS_REVIEW": "amber"}


def date_of(as_of: dt.date | dt.datetime | str | None) -> Column:
    """The day a report is made for; today when none is given."""
    return F.current_date() if as_of is None else F.lit(str(as_of)).cast("timestamp").cast("date")


def instant_of(as_of: dt.date | dt.datetime | str | None) -> Column:
    """The moment a report is made for; now when none is given."""
    return F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def epoch_ms_to_ts(ms: Column) -> Column:
    """UTC timestamp of epoch milliseconds; absent and zero both mean unknown."""
    return F.timestamp_millis(F.nullif(ms, F.lit(0).cast("bigint")))


def owner_from_path(path: Column) -> Column:
    """The folder name after the last /Users/ in a path; other paths stand for themselves."""
    inside = F.substring_index(F.substring_index(path, "/Users/", -1), "/", 1)
    return F.when(path.contains("/Users/"), inside).otherwise(
        F.coalesce(blank_to_null(path), F.lit("unknown"))
    )


def is_error() -> Column:
    """True for a message that did not complete or carries an error; null when only the status is unknown."""
    return (F.col("status") != COMPLETED) | F.col("error_type").isNotNull()


def tally(condition: Column) -> Column:
    """Number of rows for which the condition is true (0, not null, when there are none)."""
    return F.sum(F.when(condition, 1).otherwise(0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; null, meaning not measured, when there is nothing to share."""
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 1))


def p90(seconds: str) -> Column:
    """The exact 90th percentile, the smallest value that nine tenths don't exceed, with one decimal.

    Rounding keeps the order, so values may be rounded first; an aggregate then holds a count per tenth of a second
    that occurs, however many messages there are.
    """
    return F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY round({seconds}, 1))")


def questions_run() -> Column:
    """Questions a run got through: num_done, or the size of the run where that is absent or zero."""
    return F.coalesce(F.when(F.col("num_done") > 0, F.col("num_done")), F.col("num_questions"))


def run_recency() -> Column:
    """Orders runs in time; a missing time is oldest, equal times go by run id (numeric where it is a number)."""
    run_id = F.col("eval_run_id")
    return F.struct(
        F.col("created_timestamp").alias("ts"),
        run_id.try_cast("bigint").alias("number"),
        run_id.alias("name"),
    )


def run_order() -> list[Column]:
    """The same order as sort columns, oldest first."""
    run_id = F.col("eval_run_id")
    return [
        F.col("created_timestamp").asc_nulls_first(),
        run_id.try_cast("bigint").asc_nulls_first(),
        run_id.asc_nulls_first(),
    ]


def threshold_bucket(value: Column) -> Column:
    v = F.coalesce(value, F.lit(0.0))
    return F.when(v >= GREEN_FROM, "green").when(v >= AMBER_FROM, "amber").otherwise("red")


def lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def grade_score(grade: Column) -> Column:
    return lookup(grade, GRADE_SCORES)


def impact_rank(impact: Column) -> Column:
    """high, medium, low, then anything else, null included."""
    return F.coalesce(lookup(impact, IMPACT_ORDER), F.lit(3))


def clipped(name: str, chars: int | None) -> Column:
    """A text column whole, or its first `chars` characters."""
    return F.col(name) if chars is None else F.substring(name, 1, chars).alias(name)
