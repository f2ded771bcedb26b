"""The Merkle manifest and the prefix trie against plain versions, and their corner cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetscore.llm import merkle, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place string, group string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc, more=0):
    doc_id, text, lang, source, n = doc[:5]
    n = None if n is None else n + more
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def plain_tree(leaves, fanout):
    """Root, and for each leaf its siblings as (left, right) per level."""
    level, proofs, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            first = i - i % fanout
            proofs[k].append((level[first:i], level[i + 1: first + fanout]))
        level = [sha(*level[i: i + fanout]) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], proofs


def plain_manifest(docs, fanout):
    groups = defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        rows = sorted(groups[g], key=lambda d: (d[0] is not None, d[0] or 0, leaf_of(d)))
        trees[g] = rows, *plain_tree([leaf_of(d) for d in rows], fanout)
    root, upper = plain_tree([trees[g][1] for g in order], fanout)
    out = []
    for g, above in zip(order, upper):
        rows, subroot, proofs = trees[g]
        for d, proof in zip(rows, proofs):
            touched = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            h = leaf_of(d, int(touched))
            for left, right in proof + above:
                h = sha(*left, h, *right)
            out.append((d[0], leaf_of(d), subroot, root, sha(*(x for left, right in proof + above for x in left + right)), h, h == root))
    return sorted(out, key=repr)


def some_docs(n, seed):
    rng = random.Random(seed)
    docs = [(k, f"text {rng.random()} é", rng.choice(["en", "en", "en", "de", "é", "z", None, ""]), rng.choice(["a", None]),
             rng.choice([k, k, None]), "x", "y", "z") for k in range(n)]
    return docs + [docs[0], docs[0], (None, None, None, None, None, "x", "y", "z"), (5, "", "en", "", 2**63 - 1, "x", "y", "z"), (7, "long " * 60_000, "en", "a", 3, "x", "y", "z")]


@pytest.mark.parametrize("fanout, levels, n", [(2, 12, 50), (2, 2, 150), (3, 1, 90), (2, 1, 31), (4, 2, 200)])
def test_manifest_is_the_plain_tree(spark, fanout, levels, n):
    docs = some_docs(n, n)
    more = merkle.document_leaf(F.col("n_chars").cast("decimal(38,0)") + 1)
    touched = F.when((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), more)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    got = merkle.manifest(frame, F.col("doc_id"), F.col("lang"), merkle.document_leaf(), touched, fanout, levels)
    rows = sorted((tuple(r) for r in got.select("order", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)
    assert rows == plain_manifest(docs, fanout)


def test_manifest_finds_what_was_tampered_with(spark):
    docs = some_docs(60, 1)
    rows = merkle.document_manifest(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs) and len({r.root for r in rows}) == 1
    n_chars = {d[0]: d[4] for d in docs}
    for r in rows:
        if r.doc_id not in (5, 7):
            touched = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and n_chars[r.doc_id] is not None
            assert r.verified != touched


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "t", "en", "s", 1, "x", "y", "z")], DOCS)
    (r,) = merkle.document_manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified
    assert merkle.document_manifest(one.where("false")).count() == 0


# --- prefix trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, place string"


def plain_trie(rows, openings):
    own = defaultdict(list)
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    whole = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    if openings:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in whole}
        base = {c: c - (abs(c) % 100) * (1 if c >= 0 else -1) for c in whole}
        whole = {c: whole.get(base[c], [])[: h[c]] + ts[h[c]:] for c, ts in whole.items()}
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    sums = {}
    for k in sorted(members, key=len, reverse=True):
        saved = (len(members[k]) - 1) * len(k[-1][1]) if k else 0
        sums[k] = (sum(sums[c][0] for c in children[k]) or 1, saved + sum(sums[c][1] for c in children[k]))
    out = []
    for k, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children[k]), *sums[k], sha(ends)))
    return sorted(out, key=repr)


def some_conversations(n, seed, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(-150, -150 + 7 * n, 7):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, longest])):
            alphabet = 2 if t < 3 else 9
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), rng.choice(["é", "b", None, "", "word " * 3][:alphabet]), "x", "y"))
    base = [(c, t, "user", f"opening {t}", "x", "y") for c in (0, 100, -100) for t in range(4)]
    return rows + base + base[:1] + [(None, 1, "user", "lost", "x", "y"), (33, None, None, None, None, None), (2, 0, "user", "long " * 60_000, "x", "y")]


@pytest.mark.parametrize("openings, wide, deep, longest", [(True, 256, 64, 9), (False, 8, 4, 30), (True, 4, 3, 150), (False, 256, 64, 200)])
def test_trie_is_the_plain_trie(spark, monkeypatch, openings, wide, deep, longest):
    monkeypatch.setattr(trie, "WIDE", wide)
    monkeypatch.setattr(trie, "DEEP", deep)
    rows = some_conversations(60, wide + deep, longest)
    placed = trie.turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    if openings:
        placed, lengths = trie.with_shared_openings(placed)
    else:
        lengths = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    got = trie.prefix_trie(placed, lengths).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows, openings)


def test_trie_of_no_conversations(spark):
    placed, lengths = trie.with_shared_openings(trie.turns(spark.createDataFrame([], CONVERSATIONS)))
    assert trie.prefix_trie(placed, lengths).count() == 0


def test_one_conversation_copied_many_times(spark):
    rows = [(c, t, "user", f"turn {t}", "x", "y") for c in range(700) for t in range(3)]
    placed = trie.turns(spark.createDataFrame(rows, CONVERSATIONS))
    got = trie.prefix_trie(placed, placed.groupBy("conv_id").agg(F.count("*").alias("n"))).orderBy("depth").collect()
    assert [(r.conv_id, r.n_convs, r.n_children, r.n_leaves) for r in got] == [(0, 700, 1, 1)] * 3 + [(0, 700, 0, 1)]
    assert got[3].ends_sha256 == sha(",".join(map(str, range(700))))
    assert [r.saved_tokens for r in got] == [699 * 18, 699 * 18, 699 * 12, 699 * 6]
