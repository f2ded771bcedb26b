"""Merkle manifest of a dataset by a butterfly exchange.

Leaves are hashed from the columns of a row, in Spark, and get their place in their group from a range sort of
(group, order, leaf); texts don't move. Each group is dealt to partitions of fanout ** block_levels consecutive
leaves, so every partition is the leaves of one whole subtree, and reduced to that subtree's root where it lies.

Then partitions exchange: in round r, those that differ in digit r (base fanout) of their number only form an aligned
group and swap the roots of their subtrees. Each hashes the common ancestor itself, so after the rounds every
partition has the group's root and all upper siblings; no pass back down follows. Where the last subtree is not whole,
its partitions answer in turn for the missing ones. A round is one equi-join of one row a partition. The groups' roots
are leaves of one more tree of the same kind. Last, each partition joins its own lower proofs with its upper ones.

Null group: a group of its own, before all others. Null order: first. Null field: `-`, other than an empty text. Rows
with equal order go by leaf; repeated rows are leaves of their own with equal hashes. An empty table has no leaves and
gives no rows. Tampering never changes a row whose tampered leaf is null. Other columns, whatever their names, are not
looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import settle
from fleetscore.llm.running import running

_PROOF = "group string, block long, root string, proof array<string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(leaves: list[str], fanout: int, stop: int | None) -> list[list[str]]:
    """All levels of a tree from its leaves up to one node, or up to level `stop`."""
    out = [leaves]
    while (len(out) <= stop) if stop is not None else len(out[-1]) > 1:
        out.append([_hash(out[-1][k: k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def _stop(n: int, fanout: int, block_levels: int) -> int | None:
    """Levels inside a partition; a group of one partition ends with its root."""
    return block_levels if n > fanout ** block_levels else None


def block_root(table: pa.Table, fanout: int, block_levels: int) -> pa.Table:
    """One row: the root of the partition's own subtree."""
    rows = table.sort_by("place")
    n = rows["n"][0].as_py()
    top = _levels(rows["leaf"].to_pylist(), fanout, _stop(n, fanout, block_levels))[-1][0]
    return pa.table({
        "group": rows["group"].slice(0, 1), "block": rows["block"].slice(0, 1),
        "blocks": pa.array([-(-n // fanout ** block_levels)], pa.int64()), "root": pa.array([top])})


def exchange(blocks: DataFrame, fanout: int) -> DataFrame:
    """(group, block, root, proof) of (group, block, blocks, root): root of the whole group and the siblings on the way."""
    state = blocks.withColumn("proof", F.array().cast("array<string>"))
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    width = 1  # partitions of a subtree
    while width < most:
        own = F.floor(F.col("block") / width).cast("long")
        peer = own - own % fanout + F.col("digit")
        start = peer * width
        held = F.least(F.lit(width).cast("long"), F.col("blocks") - start)  # partitions of the peer's subtree
        asks = (
            state.withColumn("digit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fanout - 1).cast("long"))))
            .where((F.col("blocks") > width) & (peer != own) & (start < F.col("blocks")))
            .select("group", F.col("block").alias("to"), "digit", (start + F.col("block") % width % held).alias("block")))
        answers = asks.join(state.select("group", "block", F.col("root").alias("peer")), ["group", "block"]).groupBy(
            "group", F.col("to").alias("block")).agg(F.sort_array(F.collect_list(F.struct("digit", "peer"))).alias("peers"))
        peers = F.coalesce("peers", F.array().cast("array<struct<digit:bigint,peer:string>>"))
        run = F.array_sort(F.concat(peers, F.array(F.struct((own % fanout).alias("digit"), F.col("root").alias("peer")))))
        moved = state.join(answers, ["group", "block"], "left")
        state = settle(moved.select(
            "group", "block", "blocks",
            F.when(F.col("blocks") > width, F.sha2(F.array_join(run["peer"], ""), 256)).otherwise(F.col("root")).alias("root"),
            F.concat("proof", peers["peer"]).alias("proof")), "merkle-round")
        width *= fanout
    return state.select("group", "block", "root", "proof")


def folded(leaf: str, siblings: list[str], place: int, n: int, fanout: int) -> tuple[str, int]:
    """The root that a leaf and its siblings give in a tree of n leaves, and how many siblings it took."""
    used = 0
    while n > 1:
        left = place % fanout
        right = min(fanout, n - (place - left)) - left - 1
        leaf = _hash([*siblings[used: used + left], leaf, *siblings[used + left: used + left + right]])
        used, place, n = used + left + right, place // fanout, -(-n // fanout)
    return leaf, used


def proofs(leaves: pa.Table, upper: pa.Table, fanout: int, block_levels: int) -> pa.Table:
    """Each leaf of a partition with its whole proof, and the root that the tampered or else the own leaf folds to."""
    rows = leaves.sort_by("place")
    n, at = rows["n"][0].as_py(), rows["place"].to_pylist()
    levels = _levels(rows["leaf"].to_pylist(), fanout, _stop(n, fanout, block_levels))
    above = upper["proof"][0].as_py()
    top, group_place, groups = (upper[c][0].as_py() for c in ("top", "group_place", "groups"))
    found, back = [], []
    for k, (leaf, tampered) in enumerate(zip(rows["leaf"].to_pylist(), rows["tampered"].to_pylist())):
        siblings, own = [], k
        for level in levels[:-1]:
            first = own - own % fanout
            siblings += level[first:own] + level[own + 1: first + fanout]
            own //= fanout
        siblings = siblings + above
        found.append(_hash(siblings))
        subroot, used = folded(leaf if tampered is None else tampered, siblings, at[k], n, fanout)
        back.append(folded(subroot, siblings[used:], group_place, groups, fanout)[0])
    return pa.table({
        "order": rows["order"], "leaf": rows["leaf"], "subroot": pa.array([upper["subroot"][0].as_py()] * len(rows)),
        "root": pa.array([top] * len(rows)), "proof_sha256": pa.array(found), "folded_root": pa.array(back)})


def _blocks(leaves: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """(group, block, root, proof) for leaves of (group, place, n, block, leaf)."""
    def reduced(table: pa.Table) -> pa.Table:
        return block_root(table, fanout, block_levels)

    roots = leaves.select("group", "block", "place", "n", "leaf").groupBy("group", "block").applyInArrow(
        reduced, "group string, block long, blocks long, root string")
    return exchange(settle(roots, "merkle-blocks"), fanout)


def manifest(rows: DataFrame, order: Column, group: Column, leaf: Column, tampered: Column | None = None,
             fanout: int = 2, block_levels: int = 12) -> DataFrame:
    """order, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    Leaves of a group ascend by `order`; groups ascend bytewise. `tampered`, where not null, takes the place of the leaf
    when its root is folded from the original siblings; a row is verified if that gives the root.
    """
    def inner_proofs(table: pa.Table) -> pa.Table:
        return _own_proofs(table, fanout, block_levels)

    def whole_proofs(table: pa.Table, upper: pa.Table) -> pa.Table:
        return proofs(table, upper, fanout, block_levels)

    key = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("-"))
    narrow = rows.select(key.alias("group"), order.alias("order"), leaf.alias("leaf"),
                         (F.lit(None).cast("string") if tampered is None else tampered).alias("tampered"))
    size = fanout ** block_levels
    placed = running(narrow, ["group"], [F.col("order").asc_nulls_first(), F.col("leaf").asc()], "place", {}, "merkle-leaves")
    counts = settle(placed.groupBy("group").agg(F.count("*").alias("n")), "merkle-groups")
    leaves = settle(placed.join(counts, "group").withColumn("block", F.floor(F.col("place") / size).cast("long")), "merkle-places")
    lower = settle(_blocks(leaves, fanout, block_levels), "merkle-lower")

    # "-" sorts behind "+", so the null group is put first by name.
    subroots = lower.where("block = 0").select("group", "root").withColumn("null_first", F.when(F.col("group") == "-", 0).otherwise(1))
    tops = running(subroots.withColumn("all", F.lit("+")), ["all"], [F.col("null_first"), F.col("group")], "place", {}, "merkle-subroots")
    groups = counts.count()
    tops = tops.select(F.col("all").alias("group"), F.col("group").alias("name"), "place", F.lit(groups).cast("long").alias("n"),
                       F.col("root").alias("leaf"), F.floor(F.col("place") / size).cast("long").alias("block"))
    tops = settle(tops, "merkle-tops")
    above = _blocks(tops, fanout, block_levels).withColumnsRenamed({"root": "top", "proof": "above"}).drop("group")
    own = tops.groupBy("block").applyInArrow(
        inner_proofs, "name string, place long, subroot string, inner array<string>, block long")
    named = own.join(above, "block").select(
        F.col("name").alias("group"), F.col("place").alias("group_place"), "subroot", "top", F.concat("inner", "above").alias("over"))
    uppers = lower.select("group", "block", "proof").join(named, "group").select(
        "group", "block", F.concat("proof", "over").alias("proof"), "subroot", "top", "group_place", F.lit(groups).cast("long").alias("groups"))
    kind = rows.select(order.alias("o")).schema["o"].dataType.simpleString()
    out = leaves.groupBy("group", "block").cogroup(uppers.groupBy("group", "block")).applyInArrow(
        whole_proofs, f"order {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _own_proofs(table: pa.Table, fanout: int, block_levels: int) -> pa.Table:
    """The siblings of each leaf inside its partition."""
    rows = table.sort_by("place")
    levels = _levels(rows["leaf"].to_pylist(), fanout, _stop(rows["n"][0].as_py(), fanout, block_levels))
    inner = []
    for k in range(len(rows)):
        siblings, own = [], k
        for level in levels[:-1]:
            first = own - own % fanout
            siblings += level[first:own] + level[own + 1: first + fanout]
            own //= fanout
        inner.append(siblings)
    return pa.table({"name": rows["name"], "place": rows["place"], "subroot": rows["leaf"],
                     "inner": pa.array(inner, pa.list_(pa.string())), "block": rows["block"]})


def document_leaf(n_chars: Column | None = None) -> Column:
    """The leaf of a documents row; `n_chars` replaces that column."""
    n = F.col("n_chars") if n_chars is None else n_chars
    return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))])


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang and doc_id; rows whose crc32 of the id is a multiple of 7 are tampered with,
    which adds 1 to n_chars (nulls stay)."""
    more = document_leaf(F.col("n_chars").cast("decimal(38,0)") + 1)
    touched = F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), more)
    out = manifest(docs, F.col("doc_id"), F.col("lang"), document_leaf(), touched)
    return out.withColumnRenamed("order", "doc_id")
