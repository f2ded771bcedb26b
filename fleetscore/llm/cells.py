"""Links across components inside candidate groups, without rows of pairs.

Groups (keys with the nodes that share them) overlap: the near copies of one text meet under many keys. Here a node
belongs to a cell, whatever the key: to a part of the family of nodes that meet the same least node. A key names the
pairs of cells that meet in it, each pair of cells is verified once as a whole from the sets, and only pairs that can
join two components: a component with many nodes in a family has cells of its own, which aren't held against
each other. A cell's sets are of one band of sizes, and a link spans neighbouring bands at most. A key whose nodes are of
many families is cut to cells of its own instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import settle

CELL, CELL_SHINGLES = 384, 1 << 20  # nodes and set elements of a cell, about


def as_set(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False).view(np.uint64)


def spanning(nodes: list, roots: list, ok: np.ndarray) -> list[tuple]:
    """Of the pairs marked in ok, those that join components not joined yet."""
    parent = {r: r for r in roots}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1))):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            parent[a] = b
            links.append((nodes[i], nodes[j]))
    return links


def stored_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        yield batch, [as_set(row) for row in batch.column("shingles")]


def check_cells(batches: Iterator[pa.RecordBatch], linked: Callable[[list[np.ndarray]], np.ndarray], read: Callable = stored_sets) -> Iterator[pa.RecordBatch]:
    """Rows in order of (a, b), a pair of cells: links that join components within the pair. `linked` has sets in, all their links out."""
    at, held, kind = None, [], None

    def flush() -> pa.RecordBatch:
        links = []
        if held:
            nodes, roots, cells, sets = map(list, zip(*held))
            if len(set(roots)) > 1:
                names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
                group, cell = np.array([names[r] for r in roots]), np.array(cells)
                ok = linked(sets) & (group[:, None] != group[None, :])
                if at[0] != at[1]:
                    ok &= cell[:, None] != cell[None, :]
                links = spanning(nodes, roots, ok)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], kind) for k in (0, 1)], ["u", "v"])

    for batch, sets in read(batches):
        kind = batch.schema.field("node").type
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b"))))
        rest = zip(*(batch.column(c).to_pylist() for c in ("node", "root", "cell")), sets)
        for key, (node, root, cell, row) in zip(keys, rest):
            if key != at:
                if held:
                    yield flush()
                at, held = key, []
            held.append((node, root, cell, row))
    if held:
        yield flush()


def mixed(members: DataFrame, roots: DataFrame, smallest: int = 3) -> DataFrame:
    """(key, node, root, size, least) for the keys of `smallest` or more nodes that lie in several components; of keys with the same nodes, one."""
    held = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    several = held.groupBy("key").agg(
        F.count("*").alias("size"), F.min("root").alias("a"), F.max("root").alias("b"), F.min("node").alias("least"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where(f"a != b and size >= {smallest}")
    once = several.groupBy("size", "a", "b", "who").agg(F.min(F.struct("key", "least")).alias("x")).select("size", "x.*")
    return held.join(once, "key")


def cross_links(members: DataFrame, roots: DataFrame, sizes: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame],
                linked: Callable[[list[np.ndarray]], np.ndarray], share: tuple[int, int], purpose: str, read: Callable = stored_sets,
                smallest: int = 3, most: int = CELL) -> DataFrame:
    """Links (u, v) that join components of nodes under one key.

    members: distinct (key, node); roots: (node, root) of linked nodes, others are their own; sizes: (node, n);
    sets: (node, shingles), or a function that adds to rows with a node what `read` makes sets of. Linked sets are of a similarity of share[0] / share[1] at least, so their sizes are too.
    smallest: keys of fewer nodes are settled already, those of two by the star of their least node. most: nodes of a cell, about.
    """
    held = settle(mixed(members, roots, smallest), f"{purpose}-held")

    wide = math.log(share[1] / share[0]) * (1 + 1e-9) or 1e-9
    family = held.groupBy("node").agg(F.min("least").alias("family"), F.min("root").alias("root")).join(sizes, "node")
    family = settle(family.select(
        "node", "family", "root", "n", F.floor(F.log("n") / wide).alias("band")), f"{purpose}-families")
    many = family.groupBy("family", "root").agg(F.count("*").alias("c")).where(F.col("c") >= most).select(
        "family", "root", F.col("root").alias("pure"))
    parted = family.join(many, ["family", "root"], "left").withColumn("part", F.xxhash64("pure"))
    width = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / CELL_SHINGLES)).alias("width")
    widths = parted.groupBy("family", "part", "band").agg(width)
    place = parted.join(widths, ["family", "part", "band"]).select(
        "node", "n", "band", F.xxhash64("family", "part", "band", F.pmod(F.xxhash64("node"), "width")).alias("cell"))
    placed = settle(held.join(place, "node"), f"{purpose}-placed")

    # Keys of many families: cells of their own.
    spread = placed.groupBy("key").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("m"), width)
    spread = spread.select("key", "width", (F.col("cells") > 8 + 4 * F.ceil(F.col("m") / most)).alias("alone"))
    own = F.xxhash64("key", "band", F.pmod(F.xxhash64("node"), "width"), F.lit(1))
    at = settle(placed.join(spread, "key").select(
        "key", "node", "root", "band", F.when(F.col("alone"), own).otherwise(F.col("cell")).alias("cell")), f"{purpose}-cells")
    met = at.groupBy("key", "cell", "band").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    alike = met.groupBy("key").agg(
        F.count("*").alias("c"), F.min("cell").alias("low"), F.sum(F.xxhash64("cell", "r1", "r2").cast("decimal(38,0)")).alias("sum"))
    alike = alike.groupBy("c", "low", "sum").agg(F.min("key").alias("key")).select("key")
    met = met.join(alike, "key")
    side = lambda c: met.select("key", F.col("cell").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("band", "r1", "r2")])
    one_root = "a_r1 = a_r2 and b_r1 = b_r2 and a_r1 = b_r1"
    pairs = settle(
        side("a").join(side("b"), "key").where(f"a <= b and abs(a_band - b_band) <= 1 and not ({one_root})").select("a", "b").distinct(),
        f"{purpose}-pairs")
    inside = at.select("cell", "node", "root").distinct()
    rows = pairs.withColumn("cell", F.explode(F.array_distinct(F.array("a", "b")))).join(inside, "cell")
    if callable(sets):
        rows = sets(settle(rows, f"{purpose}-rows"))
    else:
        rows = rows.join(sets, "node")
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "node")
    kind = members.schema["node"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from check_cells(batches, linked, read)

    return settle(rows.mapInArrow(check, f"u {kind}, v {kind}"), f"{purpose}-links")
