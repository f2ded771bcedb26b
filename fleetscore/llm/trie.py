"""Prefix trie of conversations from vertical bitmaps.

A turn is the MD5 of its role's length, role and text; texts go no further. A node is the sequence of the first d turns,
named by 128 bits: the sums, over those turns, of two hashes of (turn, position). Sums can be taken in parts, so a
conversation of any length is cut to stretches of DEEP turns, each with the name of the node that it starts from.

1. Conversations in order of their id are dealt to shards of WIDE, and each (shard, stretch) is one bounded group. In it
   an index maps (position, turn) to the bitset of the shard's conversations that have it there. From a node's bitset,
   the children are found depth first: the turn of the lowest conversation left names a posting, whose intersection with
   the bitset is the child and leaves the rest. Its popcount counts members, its lowest bit is the smallest of them,
   its intersection with those that end here is the end list.
2. Nodes of equal name are summed over shards. End lists are packed ids of one shard each; read in order of the shards
   they are in order of the ids, and one hasher runs over them.
3. A node whose parent has the same smallest member continues the parent's chain, so chains are paths and one smallest
   member names one chain. Sums over a subtree are the chain's own nodes from here on plus whole chains that hang on
   them: totals of chains by pointer doubling (each round doubles the distance looked at), then one running sum.

Null conv_id: no conversation, such rows are left out. Null turn: first. Null role or text: empty. Equal turn numbers go
by the MD5, so their order doesn't depend on the order of the rows; repeated rows are turns of their own. No
conversation: no rows, not even a root. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import settle
from fleetscore.llm.running import running

WIDE, DEEP = 256, 64  # conversations of a shard, turns of a stretch
_ROOT = bytes(16)
_LOCAL = "key binary, parent binary, depth long, n long, conv_id long, chars long, shard long, ends binary"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_id, chars of conversations (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn_id = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id.alias("turn_id"), F.length(text).cast("long").alias("chars"))
    return running(narrow, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("turn_id").asc()], "place", {}, "turns").drop("turn")


def with_shared_openings(placed: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt, as turns (conv_id, place, turn_id, chars) and lengths (conv_id, n).

    Conversation c gets the first h turns of conversation c - c % every (all it has, none if there is none), then its
    own turns behind its first h; h is crc32 of c as text modulo `most`, so an opening turn is used `every` times at most.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    bases = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = settle(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own"), "conversations")
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_id", "chars")
    opening = placed.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    opening = opening.join(convs.where("taken > 0").select("conv_id", "base", "taken"), "base").where("place < taken").select(
        "conv_id", "place", "turn_id", "chars")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return own.unionByName(opening), lengths


def shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one stretch of one shard; the first stretch also has the root."""
    col = {c: table.column(c).to_pylist() for c in table.column_names}
    ids = sorted(set(col["conv_id"]))
    bit = {c: k for k, c in enumerate(ids)}
    posting: dict[tuple, int] = {}
    row_of: dict[tuple[int, int], int] = {}
    alive: dict[int, int] = {}
    ending: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}
    mask = (1 << 64) - 1
    first = min(col["depth"])
    for row, (conv, depth, turn, n) in enumerate(zip(col["conv_id"], col["depth"], col["turn_id"], col["n"])):
        b = 1 << bit[conv]
        if n == depth:
            ending[depth] = ending.get(depth, 0) | b
        if depth == first:  # every conversation of a stretch has its first depth
            start = (int(col["s1"][row]) & mask, int(col["s2"][row]) & mask)
            starts[start] = starts.get(start, 0) | b
        if turn is None:
            continue
        posting[depth, turn] = posting.get((depth, turn), 0) | b
        row_of[depth, bit[conv]] = row
        alive[depth] = alive.get(depth, 0) | b
    out = []

    def emit(key: bytes, parent: bytes | None, depth: int, members: int, chars: int) -> None:
        low = (members & -members).bit_length() - 1
        own, at = members & ending.get(depth, 0), []
        while own:
            at.append(ids[(own & -own).bit_length() - 1])
            own &= own - 1
        out.append((key, parent, depth, members.bit_count(), ids[low], chars, col["shard"][0], np.array(at, "<i8").tobytes() if at else None))

    stack = []
    for (a, b), members in starts.items():
        if first == 0:
            emit(_ROOT, None, 0, members, 0)
        stack.append((a, b, first - (first > 0), members))
    while stack:
        a, b, depth, members = stack.pop()
        rest, depth = members & alive.get(depth + 1, 0), depth + 1
        parent = a.to_bytes(8, "big") + b.to_bytes(8, "big")
        while rest:
            row = row_of[depth, (rest & -rest).bit_length() - 1]
            child = rest & posting[depth, col["turn_id"][row]]
            rest &= ~child
            a2, b2 = (a + col["k1"][row]) & mask, (b + col["k2"][row]) & mask
            emit(a2.to_bytes(8, "big") + b2.to_bytes(8, "big"), parent, depth, child, col["chars"][row])
            stack.append((a2, b2, depth, child))
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.binary()]
    names = [x.split()[0] for x in _LOCAL.split(", ")]
    return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate(zip(names, kinds))})


def hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, shard): for each key the SHA-256 of all its ids as decimals with commas between."""
    at, hasher = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            text = ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))
            if key == at:
                hasher.update(b"," + text.encode())
                continue
            if hasher:
                keys.append(at)
                digests.append(hasher.hexdigest())
            at, hasher = key, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if hasher:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([hasher.hexdigest()])], ["key", "ends_sha256"])


def _starts(named: DataFrame) -> DataFrame:
    """conv_id, stretch, s1, s2: sums of the turns before each later stretch of the conversations that have one."""
    wide = named.where(F.col("depth") >= DEEP).select("conv_id").distinct()
    parts = named.join(wide, "conv_id", "left_semi").groupBy("conv_id", "stretch").agg(
        *[F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("k1", "k2")])
    return running(parts, ["conv_id"], [F.col("stretch")], "_at", {"s1": "k1", "s2": "k2"}, "stretches").select(
        "conv_id", "stretch", "s1", "s2")


def _over_chains(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes with each of `values` summed over the subtree below and including each node."""
    chains = settle(nodes.groupBy("conv_id").agg(*[F.sum(v).alias(v) for v in values]), "chains")
    heads = settle(nodes.where("parent_conv_id != conv_id").select("conv_id", "parent_conv_id", (F.col("depth") - 1).alias("at")), "heads")
    total, up = chains, heads.select("conv_id", F.col("parent_conv_id").alias("over"))
    while not up.isEmpty():
        add = total.join(up, "conv_id").groupBy(F.col("over").alias("conv_id")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        total = settle(total.join(add, "conv_id", "left").select(
            "conv_id", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), "chain-totals")
        up = settle(up.join(up.select(F.col("conv_id").alias("over"), F.col("over").alias("next")), "over").select(
            "conv_id", F.col("next").alias("over")), "chain-pointers")
    hung = heads.join(total, "conv_id").groupBy(F.col("parent_conv_id").alias("conv_id"), F.col("at").alias("depth")).agg(
        *[F.sum(v).alias(f"_{v}") for v in values])
    own = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values})
    below = running(own.select(*nodes.columns), ["conv_id"], [F.col("depth").desc()], "_at", {f"_b_{v}": v for v in values}, "subtrees")
    return below.withColumns({v: F.col(v) + F.col(f"_b_{v}") for v in values}).select(*nodes.columns)


def prefix_trie(placed: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `placed` has the turns (conv_id, place from 0, turn_id, chars), `lengths` every conversation and its number of turns.
    """
    order = running(lengths.withColumn("_all", F.lit(0)), ["_all"], [F.col("conv_id")], "at", {}, "conversation-order")
    shards = settle(order.select("conv_id", "n", F.floor(F.col("at") / WIDE).cast("long").alias("shard")), "shards")

    def key(*parts: Column) -> Column:
        return F.xxhash64(*parts)

    depth = F.col("place") + 1
    named = settle(placed.select(
        "conv_id", depth.alias("depth"), "turn_id", "chars", F.floor(depth / DEEP).cast("long").alias("stretch"),
        key(F.col("turn_id"), depth).alias("k1"), key(depth, F.lit(7), F.col("turn_id")).alias("k2")), "named-turns")
    none = shards.select(
        "conv_id", *[F.lit(v).cast(t).alias(c) for c, v, t in (
            ("depth", 0, "long"), ("turn_id", None, "string"), ("chars", 0, "long"), ("stretch", 0, "long"), ("k1", 0, "long"), ("k2", 0, "long"))])
    rows = named.unionByName(none).join(shards, "conv_id").join(_starts(named), ["conv_id", "stretch"], "left").withColumns(
        {s: F.coalesce(s, F.lit(0)).cast("decimal(38,0)").cast("string") for s in ("s1", "s2")})
    local = settle(rows.groupBy("shard", "stretch").applyInArrow(shard_nodes, _LOCAL), "shard-nodes")

    merged = local.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("n").alias("n_convs"),
        F.max("chars").alias("chars"))
    merged = settle(merged, "nodes")
    ends = local.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    digests = ends.mapInArrow(hash_ends, "key binary, ends_sha256 string")
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    parents = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = settle(
        merged.join(kids, "key", "left").join(digests, "key", "left").join(parents, "parent", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")), "trie")
    return _over_chains(nodes, ["n_leaves", "saved_tokens"])
