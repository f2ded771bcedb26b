"""Exact nearest codes in Hamming space by incremental multi-index hashing.

A vector's code has one bit per dimension, its sign, cut into segments of 16 bits. Vectors of equal code become
one entry with its k smallest ids, so a code that many rows share costs one entry. The index holds every entry once
per segment, under the segment's value. A round with radius r looks up all values within r bits of a query's
segments. Two codes at distance up to m * (r + 1) - 1 must have a segment within r, so what lies within that
distance is then complete: the round takes just these pairs, each at its first such segment. A query with k ids among
them is answered; the others go on with a larger radius.

Ties in distance go by id. A query finds itself, too. Null embeddings have no code: they are neither found nor
searched; a missing, null or NaN element counts as not positive. Rows with a null id aren't searched, and
found last among equals. Repeated ids are found as often as they occur (k times at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscore.llm.arrays import settle

BITS = 16
LAST = 2**63 - 1


def code_of(vector: Column, segments: int) -> Column:
    """Signs of a vector's elements, as an array of 16-bit numbers."""
    bits = [F.aggregate(
        F.transform(F.sequence(F.lit(s * BITS), F.lit(s * BITS + BITS - 1)), lambda i: F.get(vector, i)), F.lit(0),
        lambda a, x: a * 2 + F.when((x > 0) & ~F.isnan(x), 1).otherwise(0)) for s in range(segments)]
    return F.array(*bits)


def _masks(radius: int) -> Column:
    """All 16-bit numbers of up to `radius` bits, as a constant array."""
    found = [x for x in range(1 << BITS) if x.bit_count() <= radius]
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<int>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of (id, embedding) rows for each row of queries (id, embedding)."""
    widest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    m = max(1, -(-widest // BITS))
    whole = vectors.where("embedding is not null").select(F.coalesce("id", F.lit(LAST)).alias("id"), code_of(F.col("embedding"), m).alias("code"))
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    # Spark keeps k rows per code and task ahead of the shuffle.
    entries = settle(whole.withColumn("p", place).where(F.col("p") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    index = entries.select("ids", "code", F.posexplode("code").alias("segment", "value"))
    there = entries.agg(F.sum(F.size("ids"))).first()[0] or 0
    enough = min(k, there)
    left = settle(queries.where("embedding is not null and id is not null").select(
        F.col("id").alias("query_id"), code_of(F.col("embedding"), m).alias("query")).distinct(), "queries")
    parts = []
    for radius in range(BITS + 1):
        covered = m * (radius + 1) - 1
        apart = [F.bit_count(F.get("code", F.lit(s)).bitwiseXOR(F.get("query", F.lit(s)))) for s in range(m)]
        earlier = F.lit(False)
        for s in range(m):
            earlier = earlier | ((F.lit(s) < F.col("segment")) & (apart[s] <= radius))
        probes = left.select("query_id", "query", F.posexplode("query").alias("segment", "own")).select(
            "query_id", "query", "segment", "own", F.explode(_masks(radius)).alias("mask")).select(
            "query_id", "query", F.col("segment").alias("_segment"), F.col("own").bitwiseXOR(F.col("mask")).alias("_value"))
        probes = settle(probes, "probes")  # a plan can't tell how many there are, and would broadcast them
        distance = sum(apart[1:], apart[0])
        found = settle(index.join(
            probes, (F.col("segment") == F.col("_segment")) & (F.col("value") == F.col("_value")) & (distance <= covered) & ~earlier)
            .select("query_id", distance.alias("distance"), F.explode("ids").alias("id")), "found")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        best = settle(found.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        answered = best.groupBy("query_id").agg(F.count("*").alias("n")).where(
            (F.col("n") >= enough) | F.lit(radius == BITS)).select("query_id")
        parts.append(best.join(answered, "query_id"))
        left = settle(left.join(answered, "query_id", "left_anti"), "left")
        if left.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", F.when(F.col("id") < LAST, F.col("id")).alias("id"), "distance")


def sampled_queries(vectors: DataFrame, every: int = 100) -> DataFrame:
    """The stated query set: rows whose id is divisible by `every`."""
    return vectors.where(F.col("id") % every == 0)
