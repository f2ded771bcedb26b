"""MinHash near-duplicates: one-permutation hashing with optimal densification, bands, stars.

1. One pass over the texts: the set of word shingles, its fingerprint, and one band key per band. The 64-bit
   shingle hashes are dealt to bins by their top bits and the least of each bin is its value; an empty bin
   takes the value of the first non-empty bin in a fixed random sequence of its own (optimal densification).
2. Equal sets become one node, so groups of copies are counted, never paired.
3. Nodes that share a bucket of a band are linked to the bucket's least node only (a star), and these
   candidate edges are verified on full sets. Large stars are dealt out over chunks of members.
4. A bucket that still holds several components may hide a link between two members that aren't its hub. Of the members
   of such buckets, linked ones share a shingle among the rarest of their sets (a prefix under the order of counts), so only
   these groups are verified, cell by cell (see `cells`): unlinked near copies of one text share hardly any, one
   component isn't held against itself, and no rows of pairs are made.
5. Components of the links by star contraction; every row gets the smallest doc_id of its component.

Rows that are equal in text are one node whatever their ids. No words or no text: the empty set, linked with
nothing. A null doc_id never becomes a component's id unless the component has no other. Rows with equal
doc_id are treated alike: each is kept if its id is the component's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import column_bytes, mix, settle, shingles, slices, text_key, word_hasher
from fleetscore.llm.cells import CELL, as_set, cross_links, mixed

BINS = 256
CHUNK = 256  # members of a star that are verified together
BLOCK = CELL  # nodes of a cell, about


def sequences(steps: int = 64) -> np.ndarray:
    """steps x BINS: the bin that an empty bin tries at each step."""
    at = np.arange(BINS, dtype=np.uint64)
    return np.stack([mix(at * np.uint64(1_000_003) + np.uint64(t + 1)) % np.uint64(BINS) for t in range(steps)]).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row of `values`; rows without any filled bin stay as they are."""
    values, ready = values.copy(), filled.copy()
    rows = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    for step in steps:
        if not len(rows):
            return values
        source = filled[rows][:, step]
        take = source & ~ready[rows]
        r, c = np.nonzero(take)
        values[rows[r], c] = values[rows[r], step[c]]
        ready[rows[r], c] = True
        rows = rows[~ready[rows].all(axis=1)]
    for row in rows:  # few shingles: the rest takes the filled bins in turn of their hash
        have = np.flatnonzero(filled[row])
        empty = np.flatnonzero(~ready[row])
        rank = mix(have.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + empty.astype(np.uint64)[:, None])
        values[row, empty] = values[row, have[np.argmin(rank, axis=1)]]
    return values


def _sets(batch: pa.RecordBatch, n: int, words: Callable) -> list[np.ndarray]:
    h, _, _, counts = words(*column_bytes(batch.column("text")))
    ends = np.cumsum(counts)
    out = []
    for a, b in zip(ends - counts, ends):
        s = np.sort(shingles(h[a:b], n))
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s)
    return out


def sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, text) to (doc_id, t1, t2, n_shingles, node, keys)."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    edges = np.arange(BINS, dtype=np.uint64) << shift
    words, steps = word_hasher(), sequences()
    for batch in slices(batches, "text"):
        sets = _sets(batch, n, words)
        values = np.zeros((len(sets), BINS), np.uint64)
        filled = np.zeros((len(sets), BINS), bool)
        for k, s in enumerate(sets):
            if len(s):
                at = np.minimum(np.searchsorted(s, edges), len(s) - 1)
                filled[k] = (s[at] >> shift) == np.arange(BINS, dtype=np.uint64)
                values[k] = s[at]
        values = densify(values, filled, steps)
        keys = np.zeros((len(sets), bands), np.uint64)
        for band in range(bands):
            key = np.full(len(sets), band + 1, np.uint64)
            for c in range(band * rows, (band + 1) * rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, c])
            keys[:, band] = key
        flat = pa.array(keys.astype(np.int64).ravel())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("t1"), batch.column("t2"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat),
        ], ["doc_id", "t1", "t2", "n_shingles", "node", "keys"])


def _set_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    words = word_hasher()
    for batch in slices(batches, "text"):
        sets = _sets(batch, n, words)
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))], ["node", "shingles"])


def _enough(both: np.ndarray, a: np.ndarray, b: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return share[1] * both >= share[0] * (a + b - both)


def check_stars(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (hub, chunk) with the hub itself first: the members that are linked with it."""
    at, hub = None, None
    for batch in batches:
        left, right = [], []
        for h, c, node, row in zip(batch.column("hub"), batch.column("chunk"), batch.column("node"), batch.column("shingles")):
            s = as_set(row)
            if (h, c) != at:
                at, hub = (h, c), s
                continue
            small, large = (s, hub) if len(s) < len(hub) else (hub, s)
            found = np.searchsorted(large, small)
            both = int((large[np.minimum(found, len(large) - 1)] == small).sum())
            if _enough(both, len(s), len(hub), share):
                left.append(h.as_py())
                right.append(node.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["u", "v"])


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over some columns at a time."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    shared = np.bincount(column)[column] > 1  # what only one set has is in no intersection
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    out = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets are linked."""
    size = np.array([len(s) for s in sets])
    return _enough(overlaps(sets), size[:, None], size[None, :], share)


def rare_shingles(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(key, node): the shingles of each set that come first in order of their counts in all of `sets`, and that several sets have.

    Sets that are linked share one: a set of n needs ceil(share * n) in common, and all but that many less one are taken.
    """
    each = sets.select("node", F.explode("shingles").alias("key"))
    counted = each.join(each.groupBy("key").agg(F.count("*").alias("c")), "key")
    first = F.sort_array(F.collect_list(F.struct("c", F.xxhash64("key").alias("h"), "key")))
    length = F.expr(f"cast(size(x) - ({share[0]}L * size(x) + {share[1] - 1}) div {share[1]} + 1 as int)")
    ordered = counted.groupBy("node").agg(first.alias("x"))
    return ordered.select("node", F.explode(F.slice("x", F.lit(1), length)).alias("x")).where("x.c > 1").select("x.key", "node")


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of links (u, v): root is the least node of its connected component.

    Large-star and small-star steps until nothing changes; each halves the depth of what is left.
    """
    edges = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), purpose)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u != v").distinct(), purpose)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").where("u != v").distinct(), purpose)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    share: tuple[int, int] = (85, 100), bands: int = 36, rows: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see `classes`."""
    return classes(docs, id_col, text_col, shingle, share, bands, rows).drop("t1", "t2", "component")


def representatives(found: DataFrame) -> DataFrame:
    """(doc_id, t1, t2) of the rows of `classes` that aren't the one of their component that stays: the least, without id last."""
    row = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t1", "t2")
    linked = found.where("component is not null")
    best = linked.groupBy("component").agg(F.min(row).alias("best"), F.count("*").alias("size")).where("size > 1").select("component", "best")
    return linked.join(best, "component").where(~row.eqNullSafe(F.col("best"))).select("doc_id", "t1", "t2").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
            share: tuple[int, int] = (85, 100), bands: int = 36, rows: int = 7) -> DataFrame:
    """doc_id, t1, t2 (they stand for the text), n_shingles, component (null for empty sets), component_id, kept per row of docs.

    Two texts are linked when share[1] * |A & B| >= share[0] * |A | B| for their shingle sets. With 36 bands of 7
    rows a pair at 0.85 shares no bucket with a chance of 1e-6 (at 0.8: 2e-4); every other step is exact.
    """
    if bands * rows > BINS:
        raise ValueError(f"bands * rows is above {BINS}")
    t1, t2 = text_key(F.col(text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    signed = settle(texts.mapInArrow(
        partial(sign, n=shingle, bands=bands, rows=rows),
        "doc_id long, t1 long, t2 long, n_shingles long, node binary, keys array<long>"), "signed")
    full = signed.where("node is not null")
    nodes = full.groupBy("node").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "t1", "t2")).alias("at"), F.min("doc_id").alias("least_id"),
        F.max("n_shingles").alias("n"))

    entries = full.select("node", "keys").distinct().select("node", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
    members = settle(entries.join(buckets, "key"), "members")

    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("at.d").alias("d"), F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2"))
    sets = settle(
        texts.withColumn("d", F.coalesce("doc_id", F.lit(2**63 - 1))).drop("doc_id").join(wanted, ["d", "t1", "t2"])
        .select("node", "text").mapInArrow(partial(_set_rows, n=shingle), "node binary, shingles array<long>"), "sets")

    stars = members.where("node != hub").select("hub", "node").distinct()
    width = stars.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("width"))
    stars = stars.join(width, "hub").select("hub", F.pmod(F.xxhash64("node"), "width").alias("chunk"), "node")
    centres = stars.select("hub", "chunk").distinct().withColumn("node", F.col("hub"))
    dealt = (
        stars.withColumn("place", F.lit(1)).unionByName(centres.withColumn("place", F.lit(0))).join(sets, "node")
        .repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "place", "node"))
    star_links = settle(dealt.mapInArrow(partial(check_stars, share=share), "u binary, v binary"), "star-links")

    roots = settle(components(star_links), "roots")
    apart = settle(mixed(members.select("key", "node"), roots).select("node").distinct(), "bands-apart")
    rare = settle(rare_shingles(sets.join(apart, "node", "left_semi"), share), "bands-rare")
    more_links = cross_links(rare, roots, nodes.select("node", "n"), sets, partial(linked, share=share), share, "bands", smallest=2, most=BLOCK)

    # A component of star links is one node from here on.
    over = more_links.join(roots.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(
        roots.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left").select(
        F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    tops = components(over).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = nodes.select("node", "least_id").join(roots, "node", "left").select(
        "node", "least_id", F.coalesce("root", "node").alias("root")).join(tops, "root", "left").select(
        "node", "least_id", F.coalesce("top", "root").alias("top"))
    least = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
    named = settle(named.join(least, "top").select("node", F.col("top").alias("component"), "component_id"), "named")
    return signed.join(named, "node", "left").select(
        "doc_id", "t1", "t2", "n_shingles", "component",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
