"""Mixing sources to target weights along a time-varying curriculum.

Sizes are summed per source; the targets follow from one water level: a source gets level * weight, but at most
`most` times its size, and the level is raised until the shares add up to the budget. Within a source, documents
follow each other in the order of a hash, so their words cover [0, size), and a second pass covers
[size, 2 * size). What lies below the source's target is taken. The curriculum says when: each source has a
piecewise linear weight schedule over the training time [0, 1]; its integral is the source's cumulative demand
for words, and the inverse of that at a document's first word is the document's position.

The running sum needs no task per source: documents are dealt to (source, high bits of the hash), the sums of
these buckets are summed up per source, and only a bucket's own rows are ordered in one task; the number of
bits follows the number of rows, which doesn't change any result.

Null or empty texts have size 0 and are never taken; a null source is a source of its own, last in order.
Documents equal in hash and id (repeated rows) follow each other in any order, with equal sizes. The document
at the border of a target gives only its first words. Integer word counts: a target's fraction isn't taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscore.llm.arrays import WORD, settle
from fleetscore.operators.ranking import ordered_rank, same_keys

Knots = Sequence[tuple[float, float]]
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES: tuple[Knots, ...] = (((0, 1), (1, 1)), ((0, 0.5), (0.5, 0.5), (1, 1.5)), ((0, 1.5), (1, 0.5)))
ROWS_PER_BUCKET = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, rk, source_size, n, weight, target) per source of rows (source, size)."""
    sources = ordered_rank(
        settle(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources"),
        [], [F.col("source").asc_nulls_last()], "rk")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = settle(sources.withColumn("weight", F.get(cycle, (F.col("rk") - 1) % len(weights))), "weights")
    cap, level, above = most * F.col("source_size"), 0.0, -1
    while True:  # each round closes at least one more source, or is the last
        full = cap < F.lit(level) * F.col("weight")
        now = sources.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("above"),
            F.sum(F.when(full, cap)).alias("closed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if now.above == above or not now.open:
            break
        above = now.above
        level = (budget * (now["all"] or 0) - (now.closed or 0.0)) / now.open
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def position_at(share: Column, knots: Knots) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches a share of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        slope, rest = (w1 - w0) / (t1 - t0), share * total - done
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        pieces.append(((done + area) / total, t0 + 2 * rest / (w0 + root)))
        done += area
    for end, expression in reversed([p for p, a in zip(pieces, areas) if a > 0]):
        out = F.when(share < end, expression).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = 1.5, schedules: Sequence[Knots] = SCHEDULES) -> DataFrame:
    """Every row of docs with size, source_size, target, taken and takes: array<struct<position, words>>, one
    for each pass that takes some of it, in order of position. Columns of docs with these names are replaced.
    """
    added = ["size", "source_size", "target", "taken", "takes"]
    docs = docs.drop(*added).withColumn("size", word_count(F.col("text"))).withColumn("_h", F.xxhash64("doc_id", "text"))
    sources = settle(source_targets(docs.select("source", "size"), weights, budget), "targets")
    rows = sources.agg(F.sum("n")).first()[0] or 0
    bits = max(4, min(20, (rows // ROWS_PER_BUCKET).bit_length()))
    docs = same_keys(docs, sources.select("source", F.col("rk").alias("_rk"), "source_size", "target"), ["source"])
    docs = docs.withColumn("_b", F.shiftright("_h", 64 - bits))
    order = Window.partitionBy("_rk", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("_rk", "_b").agg(F.sum("size").alias("_s"))
    before = Window.partitionBy("_rk").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_rk", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    docs = docs.withColumn("_start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    docs = docs.join(sums, ["_rk", "_b"]).withColumn("_start", F.col("_start") + F.col("_before"))

    def take(first: Column) -> Column:
        words = F.least(F.col("size"), F.greatest(F.floor("target") - first, F.lit(0)))
        share = first / F.col("target")
        at = F.lit(0.0)
        for k, knots in enumerate(schedules):
            at = F.when((F.col("_rk") - 1) % len(schedules) == k, position_at(share, knots)).otherwise(at)
        return F.when(words > 0, F.struct(at.alias("position"), words.alias("words")))

    takes = F.filter(F.array(take(F.col("_start")), take(F.col("_start") + F.col("source_size"))), lambda x: x.isNotNull())
    return docs.withColumn("takes", takes).withColumn(
        "taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    ).drop("_h", "_rk", "_b", "_before", "_start")


def training_order(docs: DataFrame, **options) -> DataFrame:
    """One row per take of a document, range-sorted by training position: docs' columns, position, taken (its words)."""
    mixed = mix(docs, **options).drop("position").select("*", F.explode("takes").alias("_take"))
    return mixed.withColumn("position", F.col("_take.position")).withColumn("taken", F.col("_take.words")).drop(
        "_take", "takes").sort("position", "doc_id")
