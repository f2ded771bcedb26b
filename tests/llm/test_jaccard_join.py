"""The n-gram Jaccard join against all pairs, its orders, and links inside cells."""

from __future__ import annotations

import random
import sys
from functools import partial
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from fleetscore.llm import cells, neardup, prefix_join  # noqa: E402
from fleetscore.llm.perplexity import Packed, bitmap  # noqa: E402

DOCS = "doc_id long, text string, key string, node string"


def corpus(seed, n=60):
    """Families of copies at many distances, lines that most texts share, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for f in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 200]))]
        for _ in range(n // 4):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words) + (f" {line}" if rng.random() < 0.6 else ""))
    rows += ["", None, " \n ", "one", "One", "one two three", "one two  three", "a b c d", line, line, line.upper(), "x " * 500, "x " * 501]
    rows.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    rng.shuffle(rows)
    out = [(k if rng.random() < 0.95 else None, t, "x", "y") for k, t in enumerate(rows)]
    return out + out[:3]


def answer(rows, n=4):
    return sorted((r[:3] for r in brute.near_duplicates([r[:2] for r in rows], n=n)), key=repr)


@pytest.mark.parametrize("seed, cell, frequent", [(1, 384, 8), (2, 4, 3), (3, 3, 2)])
def test_join_finds_all_links(spark, monkeypatch, seed, cell, frequent):
    monkeypatch.setattr(cells, "CELL", cell)
    monkeypatch.setattr(prefix_join, "FREQUENT", frequent)
    rows = corpus(seed)
    got = prefix_join.jaccard_classes(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == answer(rows)


def test_near_dedup_through_small_cells(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 3)
    rows = corpus(4)
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).select("doc_id", "n_shingles", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == answer(rows, n=3)


def test_empty_table(spark):
    assert prefix_join.jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0


def test_linked_sets_share_a_prefix_token_under_every_order():
    rng = np.random.default_rng(5)
    share = (85, 100)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.85, 0.95, 1.0])], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)]))
        demoted = {int(x): int(rng.integers(8, 20)) for x in np.concatenate([a, b]).view(np.int64) if rng.random() < 0.5}
        if len(b) and prefix_join.enough(len(np.intersect1d(a, b)), len(a), len(b), share):
            for seed in (0, *prefix_join.ORDERS):
                assert len(np.intersect1d(prefix_join.prefix(a, share, seed), prefix_join.prefix(b, share, seed)))
            assert len(np.intersect1d(prefix_join.prefix(a, share, 0, demoted), prefix_join.prefix(b, share, 0, demoted)))


def test_cells_join_components_of_one_key(spark):
    """A chain in which only neighbours are linked, under one key and without any star."""
    n = 40
    sets = [np.arange(100 * 1 + 5 * k, 100 + 5 * k + 100, dtype=np.uint64) for k in range(n)]
    frame = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in enumerate(sets)], "node long, shingles array<long>")
    members = spark.range(n).selectExpr("7L as key", "id as node")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    sizes = spark.range(n).selectExpr("id as node", "100L as n")
    for size in (384, 5):
        cells.CELL, before = size, cells.CELL
        try:
            links = cells.cross_links(members, roots, sizes, frame, partial(neardup.linked, share=(85, 100)), (85, 100), "test").collect()
        finally:
            cells.CELL = before
        assert {(r.u, r.v) for r in links} >= {(k, k + 1) for k in range(1, n - 1)}


def test_only_likely_demoted_tokens_move(spark):
    """Tokens that no set has demoted drop out by a bitmap before the join."""
    heads = spark.createDataFrame([(1, [5, 6, 7]), (2, [8, 9]), (3, [6])], "node long, head array<long>")
    demoted = spark.createDataFrame([(6, (6, 9)), (9, (9, 12))], "key long, x struct<token:long, count:long>")
    likely = spark.sparkContext.broadcast(Packed(bitmap([(0, demoted.select("key"))])))
    found = prefix_join.late_tokens(heads, demoted, likely)
    assert sorted((r.node, [tuple(x) for x in r.demoted]) for r in found.collect()) == [(1, [(6, 9)]), (2, [(9, 12)]), (3, [(6, 9)])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")
