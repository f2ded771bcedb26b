"""Exact Jaccard join of word n-gram sets by prefix filters under several global orders.

Under any one order of all tokens (hashes of n-word shingles), two sets that are similar enough share a token among
their first n - need + 1, where need is the least overlap that a set of n tokens can be linked with.

1. One pass over the texts: each set's fingerprint and its prefix under the first order. Equal sets become one node.
2. The first order starts as one of hashes, and frequent tokens move to its end: tokens that FREQUENT prefixes hold are
   demoted, by their count, and sets with one in their prefix take it anew. They look up their first HEAD times as many
   tokens in the table of demoted ones, or all if too few of those stay. A set without one in its prefix has the
   same prefix in both orders. Any order that is the same for all sets is exact; demotion makes what sets share rarer.
   Sets that share no prefix token drop out at once.
3. Sets that share a prefix token are candidates. A candidate pair must share prefix tokens under all other orders too
   (hash orders of other seeds) before its overlap is counted on full sets.
4. Pairs are settled group by group, and never written: first with the group's least node only (a star), then, where
   a group still has several components, cell by cell (see `cells`).
5. Components of the links; every row gets the smallest doc_id of its component. Every step is exact, so no link between
   different sets is lost.

Words are runs of characters other than blank and 0x09-0x0D, A-Z lower-cased. No text or no words: the empty set, linked
with nothing. Fewer words than n: the whole sequence is the one shingle. Rows equal in text are one node whatever their
ids. A null doc_id never becomes a component's id unless the component has no other. Repeated rows are repeated in the
result. An empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import forget, mix, settle, slices, text_key, word_hasher
from fleetscore.llm.cells import as_set, cross_links
from fleetscore.llm.neardup import _sets, components, overlaps
from fleetscore.llm.perplexity import Packed, bitmap, maybe

FREQUENT, HEAD = 8, 2
ORDERS = (0xA5A5_5A5A_1234_5678, 0x0F1E_2D3C_4B5A_6978)  # seeds of the second and third order
CHUNK = 256


def prefix_length(n: int, share: tuple[int, int]) -> int:
    return n - -(-share[0] * n // share[1]) + 1


def prefix(s: np.ndarray, share: tuple[int, int], seed: int = 0, demoted: dict[int, int] | None = None) -> np.ndarray:
    """The tokens of s that come first: by hash, demoted ones last and by their count."""
    k = prefix_length(len(s), share)
    rank = mix(s ^ np.uint64(seed))
    if demoted:
        last = np.array([demoted.get(x, 0) for x in s.view(np.int64).tolist()], np.int64)
        return s[np.lexsort((rank, last))[:k]]
    return s[np.argpartition(rank, k - 1)[:k]] if k < len(s) else s


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))


def sign(batches: Iterator[pa.RecordBatch], n: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, text) to (doc_id, t1, t2, n_shingles, print, first): fingerprint and first prefix of the set."""
    words = word_hasher()
    for batch in slices(batches, "text"):
        sets = _sets(batch, n, words)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
            _lists([prefix(s, share) if len(s) else s for s in sets]),
        ], ["doc_id", "t1", "t2", "n_shingles", "print", "first"])


def sets_of_texts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    words = word_hasher()
    for batch in slices(batches, "text"):
        yield batch, _sets(batch, n, words)


def heads(batches: Iterator[pa.RecordBatch], n: int, share: tuple[int, int], times: int | None) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, n, head): the size of the set, and its first tokens by hash, `times` the prefix or all."""
    words = word_hasher()
    for batch in slices(batches, "text"):
        sets = _sets(batch, n, words)
        keep = [len(s) if times is None else min(len(s), times * prefix_length(len(s), share)) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), _lists([s[np.argsort(mix(s))[:k]] for s, k in zip(sets, keep)])],
            ["node", "n", "head"])


def prefixes_anew(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(node, n, head, demoted) to (node, first, whole): whole if no token behind the head can belong to the prefix."""
    for batch in batches:
        out, whole = [], []
        for n, row, last in zip(batch.column("n").to_pylist(), batch.column("head"), batch.column("demoted").to_pylist()):
            s, known = as_set(row), {x["token"]: x["count"] for x in last}
            k = prefix_length(n, share)
            late = np.array([known.get(x, 0) for x in s.view(np.int64).tolist()], np.int64)
            whole.append(len(s) == n or int((late == 0).sum()) >= k)
            out.append(s[np.argsort(late, kind="stable")[:k]])  # the head is in order of the hash
        yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(out), pa.array(whole, pa.bool_())], ["node", "first", "whole"])


def _likely(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(maybe(shared.value, batch.column("key").to_numpy().view(np.uint64), 0)))


def late_tokens(heads: DataFrame, demoted: DataFrame, likely) -> DataFrame:
    """(node, demoted): the tokens of each head that are in the table of demoted ones; a bitmap of fixed size, broadcast, keeps most others from moving."""
    asked = heads.select("node", F.explode("head").alias("key")).mapInArrow(partial(_likely, likely), "node long, key long")
    return asked.join(demoted, "key").groupBy("node").agg(F.collect_list("x").alias("demoted"))


def enough(both, a, b, share: tuple[int, int]):
    return share[1] * both >= share[0] * (a + b - both)


def check_stars(batches: Iterator[pa.RecordBatch], n: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (hub, chunk) with the hub itself first: the members that are linked with it."""
    at, hub, heads = None, None, []
    for batch, sets in sets_of_texts(batches, n):
        left, right = [], []
        for h, c, node, s in zip(*(batch.column(x).to_pylist() for x in ("hub", "chunk", "node")), sets):
            own = [np.sort(prefix(s, share, seed)) for seed in ORDERS]
            if (h, c) != at:
                at, hub, heads = (h, c), s, own
                continue
            if not all(len(np.intersect1d(x, y, True)) for x, y in zip(heads, own)):
                continue
            if enough(len(np.intersect1d(hub, s, True)), len(hub), len(s), share):
                left.append(h)
                right.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])


def linked(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets are linked; overlaps are counted if some pair shares prefix tokens under every order."""
    candidates = np.ones((len(sets), len(sets)), bool)
    for seed in ORDERS:
        candidates &= overlaps([prefix(s, share, seed) for s in sets]) > 0
    some = np.flatnonzero((candidates & ~np.eye(len(sets), dtype=bool)).any(axis=1))
    out = np.zeros((len(sets), len(sets)), bool)
    if len(some):
        size = np.array([len(sets[k]) for k in some])
        out[np.ix_(some, some)] = enough(overlaps([sets[k] for k in some]), size[:, None], size[None, :], share)
    return out & candidates


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    share: tuple[int, int] = (85, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; sets are linked when share[1] * |A & B| >= share[0] * |A | B|."""
    t1, t2 = text_key(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    raw = settle(texts.mapInArrow(
        partial(sign, n=shingle, share=share),
        f"doc_id {kind}, t1 long, t2 long, n_shingles long, print binary, first array<long>"), "join-signed")
    # One row stands for a set; rows equal in it are equal in text.
    nodes = settle(raw.where("print is not null").groupBy("print").agg(
        F.min(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), "t1", "t2")).alias("at"), F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n"),
        F.first("first").alias("first")).withColumn("node", F.monotonically_increasing_id()), "join-nodes")

    signed = settle(raw.drop("first", "t1", "t2"), "join-rows")
    forget(raw)
    named_nodes = settle(nodes.select("print", "node", "least_id", "n"), "join-named-nodes")

    def shared(first: DataFrame) -> DataFrame:
        """(key, node, size, hub) for tokens in the prefixes of several nodes."""
        entries = first.select("node", F.explode("first").alias("key"))
        groups = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("hub")).where("size > 1")
        return entries.join(groups, "key")

    places = settle(nodes.select("node", "at.d", "at.t1", "at.t2"), "join-places")
    named_texts = texts.withColumn("d", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).select("d", "t1", "t2", "text")
    hashed = F.xxhash64("d", "t1", "t2").alias("key")

    def texts_of(which: DataFrame) -> DataFrame:
        """(d, t1, t2, text, node) of some nodes; a bitmap of fixed size keeps most other texts out of the join."""
        wanted = settle(places.join(which, "node", "left_semi"), "join-wanted")
        shared = docs.sparkSession.sparkContext.broadcast(Packed(bitmap([(0, wanted.select(hashed))])))
        near = named_texts.withColumn("key", hashed).mapInArrow(partial(_likely, shared), "d string, t1 long, t2 long, text string, key long")
        return near.drop("key").join(wanted, ["d", "t1", "t2"]).dropDuplicates(["d", "t1", "t2"])

    def with_texts(rows: DataFrame) -> DataFrame:
        """rows with the texts of their nodes: texts move rather than sets, which are larger and can't be compressed."""
        found = texts_of(rows.select("node").distinct()).drop("node")
        return rows.join(places, "node").join(found, ["d", "t1", "t2"]).select(*rows.columns, "text")

    members = settle(shared(nodes), "join-members")
    often = F.col("size") >= FREQUENT
    touched = settle(members.where(often).select("node").distinct(), "join-touched")
    demoted = settle(members.where(often).select(
        "key", F.struct(F.col("key").alias("token"), F.col("size").alias("count")).alias("x")).distinct(), "join-demoted")
    kept = settle(nodes.join(members.select("node").distinct(), "node", "left_semi").join(touched, "node", "left_anti").select("node", "first"), "join-kept")
    forget(members)
    forget(nodes)

    likely = docs.sparkSession.sparkContext.broadcast(Packed(bitmap([(0, demoted.select("key"))])))

    def anew(which: DataFrame, times: int | None) -> DataFrame:
        first = settle(texts_of(which).select("node", "text").mapInArrow(
            partial(heads, n=shingle, share=share, times=times), "node long, n long, head array<long>"), "join-heads")
        out = settle(first.join(late_tokens(first, demoted, likely), "node").mapInArrow(
            partial(prefixes_anew, share=share), "node long, first array<long>, whole boolean"), "join-prefixes")
        forget(first)
        return out

    head = anew(touched, HEAD)
    rest = anew(head.where("not whole").select("node"), None)
    first = kept.unionByName(head.where("whole").select("node", "first")).unionByName(rest.select("node", "first"))
    likely.destroy()
    members = settle(shared(first), "join-members")
    for used in (kept, head, rest):
        forget(used)

    # Sets of too different sizes can't be linked.
    size = settle(named_nodes.select("node", "n"), "join-sizes")
    stars = members.where("node != hub").select("hub", "node").distinct().join(size, "node").join(
        size.withColumnsRenamed({"node": "hub", "n": "n_hub"}), "hub").where(
        share[1] * F.least("n", "n_hub") >= share[0] * F.greatest("n", "n_hub")).select("hub", "node")
    width = stars.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).alias("width"))
    stars = stars.join(width, "hub").select("hub", F.pmod(F.xxhash64("node"), "width").alias("chunk"), "node")
    centres = stars.select("hub", "chunk").distinct().withColumn("node", F.col("hub"))
    stars = settle(stars.withColumn("place", F.lit(1)).unionByName(centres.withColumn("place", F.lit(0))), "join-stars")
    dealt = with_texts(stars).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "place", "node")
    star_links = settle(dealt.mapInArrow(partial(check_stars, n=shingle, share=share), "u long, v long"), "join-links")
    roots = settle(components(star_links, "join-components"), "join-roots")
    more = cross_links(members.select("key", "node"), roots, size, with_texts, partial(linked, share=share), share, "join",
                       partial(sets_of_texts, n=shingle))

    over = more.join(roots.withColumnsRenamed({"node": "u", "root": "ru"}), "u", "left").join(
        roots.withColumnsRenamed({"node": "v", "root": "rv"}), "v", "left").select(
        F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    tops = components(over, "join-components").select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = named_nodes.select("print", "node", "least_id").join(roots, "node", "left").select(
        "print", "least_id", F.coalesce("root", "node").alias("root")).join(tops, "root", "left").select(
        "print", "least_id", F.coalesce("top", "root").alias("top"))
    least = named.groupBy("top").agg(F.min("least_id").alias("component_id"))
    named = settle(named.join(least, "top").select("print", "component_id"), "join-named")
    return signed.join(named, "print", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
