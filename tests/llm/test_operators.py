"""The training-data operators against plain versions, and their corner cases."""

from __future__ import annotations

import base64
import hashlib
import math
import pickle
import random
import sys
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from fleetscore.llm import (  # noqa: E402
    curriculum, decontaminate, langid, line_spread, neardup, perplexity, toolcalls, topk, warc, wordpiece)
from fleetscore.session import scratch_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, a clashing extra column."""
    base = prose(60)
    rows = [
        (1, base, "en", "a", 1, "x"), (1, base, "en", "a", 1, "x"), (2, base, None, "b", None, None), (3, None, "en", "a", 0, "x"),
        (4, "", "de", None, 0, "x"), (5, " \n\t ", "de", "b", 4, "x"), (None, base, "en", None, 1, "x"), (None, None, None, None, None, None),
        (6, prose(30_000), "en", "c", 1, "x"), (7, "one", "en", "c", 3, "x"), (8, "ONE", "en", "d", 3, "x"), (9, "1234 !!", "en", "d", 3, "x"),
        (10, "\U0001d4d0\U0001d4d1 é x", "fr", "d", 3, "x"), (11, base + " more", "en", "e", 1, "x")]
    return spark.createDataFrame(rows, DOCS)


def empty(df):
    return df.where("false")


# --- tool calls

EVENT = ("conv_id string, turn long, part int, kind string, role string, call_id string, name string, arguments string, "
         "content string, after array<string>")


def test_calls_are_linked_ordered_and_checked(spark):
    rows = [
        ("a", 0, 0, "call", "assistant", "y", "f", '{"n":2.0,"b":1}', None, ["x"]), ("a", 1, 0, "result", "tool", "y", None, None, "ry", []),
        ("a", 2, 0, "call", "assistant", "x", "f", '{"n":"q"}', None, []), ("a", 3, 0, "result", "tool", "x", None, None, "rx", []),
        ("a", 4, 0, "message", "user", None, None, None, "hié\"", []), ("a", 5, 0, "call", "assistant", "c1", "g", "nojson", None, ["c2"]),
        ("a", 6, 0, "call", "assistant", "c2", "f", "{}", None, ["c1", "nowhere"]), ("a", 7, 0, "result", "tool", "zz", None, None, None, []),
        ("a", 8, 0, "call", "assistant", "x", "f", None, None, None), (None, None, 0, "call", "assistant", None, "f", '{"n":1}', None, [])]
    schemas = spark.createDataFrame([("f", '{"type":"object","required":["n"],"properties":{"n":{"type":"integer"}}}')], "name string, schema string")
    got = toolcalls.linked(spark.createDataFrame(rows, EVENT), schemas).orderBy("conv_id", "position").collect()
    assert [(r.call_id, r.kind, r.status) for r in got] == [
        (None, "call", "unanswered"), ("x", "call", "linked"), ("x", "result", "linked"), ("y", "call", "linked"), ("y", "result", "linked"),
        (None, "message", "message"), ("c1", "call", "cyclic"), ("c2", "call", "cyclic"), ("zz", "result", "orphan"), ("x", "call", "unanswered")]
    assert [list(r.problems) for r in got if r.kind == "call"] == [
        [], ["$.n: not integer"], [], ["$: not JSON"], ["$.n: missing"], ["$: not object"]]
    assert got[3].json == '{"role":"assistant","tool_calls":[{"function":{"arguments":{"b":1,"n":2},"name":"f"},"id":"y","type":"function"}]}'
    assert got[5].json == '{"content":"hié\\"","role":"user"}'


def test_bad_rows_are_problems_of_their_rows(spark):
    arguments = {
        "surrogate": '{"n":"\\ud800"}', "digits": '{"n":' + "7" * 400 + "}", "deep": "[" * 100_000 + "]" * 100_000, "null": '{"n":null}',
        "unknown": '{"n":1}', "no json": '{"n":1}', "odd": '{"n":1}', "long": '{"n":"' + "x" * 300_000 + '"}', "twice": '{"n":1}'}
    schemas = [
        ("surrogate", '{"properties":{"n":{"type":"string"}}}'), ("digits", '{"properties":{"n":{"type":"integer","minimum":0}}}'), ("deep", "{}"),
        ("null", '{"properties":{"n":{"type":["string","null"]}}}'), ("unknown", '{"properties":{"n":{"type":"date"}}}'), ("no json", "{"),
        ("odd", '{"minimum":"x","properties":{"n":{"minimum":"x"}}}'), ("long", '{"properties":{"n":{"type":"string","maxLength":9}}}'),
        ("twice", "{}"), ("twice", '{"type":"array"}')]
    rows = [("a", k, 0, "call", "assistant", f"c{k}", name, text, None, []) for k, (name, text) in enumerate(arguments.items())] * 2
    frame = spark.createDataFrame(rows, EVENT).withColumns({"nth": F.lit("x"), "position": F.lit("y"), "json": F.lit("z"), "schema": F.lit("w")})
    got = toolcalls.linked(frame, spark.createDataFrame(schemas, "name string, schema string")).collect()
    assert len(got) == len(rows)
    found = {list(arguments)[r.turn]: r for r in got}
    assert {k: list(r.problems) for k, r in found.items()} == {
        "surrogate": [], "digits": [], "deep": ["$: nested too deep"], "null": [], "unknown": ["$.n: unknown type date in schema"],
        "no json": ["$: schema can't be applied"], "odd": ["$: schema can't be applied"], "long": ["$.n: too long"], "twice": found["twice"].problems}
    assert '"n":"\\ud800"' in found["surrogate"].json and "7" * 400 in found["digits"].json


def test_call_order_is_topological(spark):
    rng = random.Random(5)
    n = 25
    deps = {k: [f"c{d}" for d in rng.sample(range(k), min(k, rng.randint(0, 3)))] for k in range(n)}
    turns = list(range(n))
    rng.shuffle(turns)
    rows = [("a", turns[k], 0, "call", "assistant", f"c{k}", "f", "{}", None, deps[k]) for k in range(n)]
    rows += [("a", rng.randint(0, n), 1, "result", "tool", f"c{k}", None, None, "r", []) for k in range(n)]
    schemas = spark.createDataFrame([("f", "{}")], "name string, schema string")
    got = toolcalls.linked(spark.createDataFrame(rows, EVENT), schemas).collect()
    at = {(r.kind, r.call_id): r.position for r in got}
    assert sorted(at.values()) == list(range(1, 2 * n + 1))
    for k in range(n):
        assert at["call", f"c{k}"] < at["result", f"c{k}"]
        assert all(at["result", d] < at["call", f"c{k}"] for d in deps[k])


def test_no_events(spark):
    schemas = spark.createDataFrame([], "name string, schema string")
    assert toolcalls.linked(spark.createDataFrame([], EVENT), schemas).count() == 0


# --- language ID

def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)


def test_language_corner_cases(spark, odd):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by[k].lang_pred, by[k].score, by[k].accepted) == ("und", 0.0, False) for k in (3, 4, 5, 9))
    assert by[1].lang_pred in ("en", "de", "fr")
    assert all(r.lang_pred == "und" for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert langid.identify(empty(odd)).count() == 0


def test_language_model_is_a_distribution(spark):
    texts = spark.createDataFrame([("abca bcab cabb", "x"), ("aab", "x")], "text string, lang string")
    models = langid.train(texts)
    model = models["x"]
    letters = [32, *map(ord, "abc")]
    for context in ("  a", "abc", "zzz"):
        high = sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context))
        log, settled = perplexity.resolve(np.array([high | c for c in letters], np.uint64), model.heads, models.bits, model.base, model.kind)
        assert settled.all()
        p = np.exp(log).sum()
        assert 0.5 < p <= 1.0001  # the rest belongs to characters that were never seen


def test_frequent_ngrams_come_to_the_driver_compressed(spark, monkeypatch):
    """In one query for all tables; no table of them is gathered as it is."""
    def refuse(_):
        raise AssertionError("a table was gathered as it is")

    texts = spark.createDataFrame([("abca bcab cabb", "x"), ("aab", "x"), ("dda", "y")], "text string, lang string")
    monkeypatch.setattr(type(texts), "toArrow", refuse)
    models = langid.train(texts, 3)
    for model in models.values():
        assert sorted(model.heads) == [(name, k) for name in ("contexts", "grams") for k in range(1, 5)]
        for keys, logs in model.heads.values():
            assert 0 < len(keys) == len(logs) <= 3 and (np.diff(keys) > 0).all() and (logs <= 0).all()


def test_joined_and_broadcast_ngrams_give_the_same_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang")
    found = []
    for head in (10**6, 500, 0):
        models = langid.train(training, head)
        found.append((models, {r.doc_id: r for r in langid.decisions(docs.select("doc_id", "text"), models).collect()}))
    for models, by in found[1:]:
        for lang, m in models.items():
            first = found[0][0][lang]
            assert all(math.isclose(getattr(m, c), getattr(first, c), rel_tol=1e-9) for c in ("own", "spread", "random"))
        for k, r in by.items():
            one = found[0][1][k]
            assert (r.lang_pred, r.accepted) == (one.lang_pred, one.accepted)
            assert r.cross_entropy is None or math.isclose(r.cross_entropy, one.cross_entropy, rel_tol=1e-9)


def test_letters_beyond_16_bits(spark):
    docs = spark.createDataFrame([(k, "\U00020020\U00020021 " * 9, "zh") for k in range(5)] + [
        (9, "plain words of letters", "en"), (10, "\U0001f600\U0001f601", "en"), (11, "\U00020020\U00020020", None)], "doc_id long, text string, lang string")
    by = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert by[11] == "zh" and by[10] == "und"


def test_random_letters_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.train(docs.select("text", "lang"))
    rng = random.Random(1)
    noise = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)),) for _ in range(5)]
    assert not any(r.accepted for r in langid.decisions(spark.createDataFrame(noise, "text string"), models).collect())


def test_random_letters_are_rejected_beside_another_script(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    rng = random.Random(2)
    han = [("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300)), "zh") for _ in range(100)]
    models = langid.train(docs.select("text", "lang").unionByName(spark.createDataFrame(han, "text string, lang string")))
    noise = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)),) for _ in range(5)]
    assert not any(r.accepted for r in langid.decisions(spark.createDataFrame(noise, "text string"), models).collect())
    rows = langid.decisions(docs.select("text"), models).where("lang_pred <> 'und'").collect()
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)


# --- mixing

def water_level(sizes, weights, budget=1.5, most=2.0):
    target = {s: 0.0 for s in sizes}
    level, total = 0.0, budget * sum(sizes.values())
    for _ in range(len(sizes) + 1):
        full = {s for s in sizes if most * sizes[s] < level * weights[s]}
        free = sum(weights[s] for s in sizes if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / free if free else level
    return {s: min(most * sizes[s], level * weights[s]) for s in target}


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = curriculum.mix(docs).drop("text").collect()
    again = curriculum.mix(docs.repartition(7)).select("doc_id", "taken", "takes").collect()
    assert sorted((r.doc_id, r.taken, str(r.takes)) for r in rows) == sorted((r.doc_id, r.taken, str(r.takes)) for r in again)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    names = sorted(sizes)
    expected = water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)})
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, expected[r.source], rel_tol=1e-9)
        assert all(0 <= t.position <= 1 for t in r.takes) and r.taken == sum(t.words for t in r.takes)
    assert all(abs(taken[s] - expected[s]) <= 1 for s in names)


def test_mix_corner_cases(spark, odd):
    rows = curriculum.mix(odd).drop("text").collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {"x", None}
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert curriculum.mix(empty(odd)).count() == 0
    order = curriculum.training_order(odd).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    assert sum(r.taken for r in order) == sum(r.taken for r in rows)


def test_positions_invert_the_schedule(spark):
    knots = ((0, 0.5), (0.5, 0.5), (1, 1.5))
    shares = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for u, t in shares.select("u", curriculum.position_at(F.col("u"), knots)).collect():
        area = 0.5 * min(t, 0.5) + (0.5 * (t - 0.5) + (t - 0.5) ** 2 if t > 0.5 else 0)
        assert math.isclose(area / 0.75, u, abs_tol=1e-9)


# --- token counts

def test_pieces_are_those_of_greedy_matching():
    rng = random.Random(2)
    some = lambda n: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}
    for _ in range(60):
        first, rest = some(12), some(12)
        automaton = wordpiece.Automaton(first, rest)
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            assert automaton.count(word) == brute.greedy_pieces(word, first, rest), (word, first, rest)


def test_token_counts_of_whole_texts(spark, odd):
    first, rest = map(set, wordpiece.read_vocabulary(wordpiece.VOCABULARY))
    texts = odd.select("doc_id", "text").where("doc_id is null or doc_id <> 6").collect()
    want = Counter()
    for r in texts:
        pieces = [brute.greedy_pieces(w, first, rest) for w in brute.WORD.findall(r.text or "")]
        want[(r.doc_id, len(pieces), sum(n or 1 for n in pieces), pieces.count(0))] += 1
    got = Counter(map(tuple, wordpiece.token_counts(odd.where("doc_id is null or doc_id <> 6")).collect()))
    assert got == want
    assert wordpiece.token_counts(empty(odd)).count() == 0


# --- line dedup

def test_lines_on_many_sites_stay_once(spark):
    rows = []
    for k in range(8):
        rows.append((k, f"own text of {k} here\n  all rights reserved \nonly here {k % 4} today\n", "en", f"s{k}", 0, "x"))
    rows += [(100, "all rights reserved", "en", "s1", 19, "x"), (101, None, "en", "s1", 0, "x"), (102, "all rights reserved\nall rights reserved", "en", None, 0, "x"),
             (None, "all rights reserved\nmore words in here", "en", "s2", 0, "x")]
    got = line_spread.remove_shared_lines(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in got}
    # nulls come first, so the line stays in the document without an id
    assert by[None].text == rows[-1][1]
    assert by[3].text == "own text of 3 here\nonly here 3 today\n" and by[3].n_chars == len(by[3].text)
    assert (by[100].text, by[100].emptied, by[102].n_removed, by[101].text) == ("", True, 2, None)
    assert sum(r.n_removed for r in got) == 8 + 1 + 2
    assert line_spread.remove_shared_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(s * 100 + k, f"line number {k} here", "en", f"site{s}", 0, "x") for k in range(40, 60) for s in range(k)]
    got = line_spread.remove_shared_lines(spark.createDataFrame(rows, DOCS), min_sites=50, lg_k=4).groupBy(
        F.regexp_extract("text", r"(\d+)", 1)).count().collect()
    removed = Counter({r[0]: r[1] for r in got})
    for k in range(40, 60):
        assert removed[str(k)] == (k if k < 50 else 1)


def test_lines_without_blanks_are_shared_lines(spark):
    line = "\u7248\u6743\u6240\u6709\u4e0d\u5f97\u8f6c\u8f7d"
    docs = [(k, f"own {k} text here\n{line}\n\u7248\u6743\nx\u7248 y", "zh", f"s{k}", 0, "x") for k in range(8)]
    got = {r.doc_id: r.text for r in line_spread.remove_shared_lines(spark.createDataFrame(docs, DOCS), min_words=3).collect()}
    assert got[0] == docs[0][1]
    assert all(got[k] == f"own {k} text here\n\u7248\u6743" for k in range(1, 8))


# --- decontamination

def test_edit_distance_of_substrings():
    rng = random.Random(1)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        want = brute.substring_distance(item, text)
        assert decontaminate.edit_distance_within(item, text) == want
        assert decontaminate.may_match(item, text, want)


def test_edited_passages_are_found(spark, prose):
    rng = random.Random(4)
    items = [(k, prose(rng.randint(12, 60))) for k in range(40)]
    docs, want = [], {}
    for k in range(120):
        text, item = prose(rng.randint(50, 300)).split(), None
        if k % 3 == 0:
            item, passage = items[k % 40]
            passage = passage.split()
            for _ in range(len(passage) // 12):
                passage[rng.randrange(len(passage))] = rng.choice(["", "XY", "pq rs"])
            at = rng.randrange(len(text))
            text[at:at] = " ".join(passage).upper().split()
        plain = " ".join(text).lower()
        want[k] = {i for i, t in items if decontaminate.edit_distance_within(t, plain) <= math.floor(0.2 * len(t))} if item is not None else set()
        docs.append((k, " ".join(text)))
    hits = decontaminate.benchmark_hits(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: {h.item_id for h in r.hits} for r in hits.collect()}
    found = sum(len(got[k] & want[k]) for k in want)
    assert found >= 0.95 * sum(map(len, want.values())) and all(got[k] <= want[k] for k in want)
    blocks = decontaminate.benchmark_hits(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=3000)
    assert {r.doc_id: {h.item_id for h in r.hits} for r in blocks.collect()} == got


def test_passages_with_spread_edits_are_found(spark):
    """A typo in each second word (about 8 % of the characters), and whole words replaced up to the limit of 20 %."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 8)))
    items = [(k, " ".join(word() for _ in range((20, 45, 58)[k % 3]))) for k in range(90)]
    docs = []
    for k, text in items:
        passage, left = text.split(), math.floor(0.2 * len(text))
        for j in rng.sample(range(len(passage)), len(passage)):
            w = passage[j]
            if k % 2 and left >= len(w):
                passage[j], left = "Z" * len(w), left - len(w)
            elif not k % 2 and rng.random() < 0.5:
                at = rng.randrange(len(w))
                passage[j] = w[:at] + "Z" + w[at + 1:]
        docs.append((k, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])))
        assert decontaminate.edit_distance_within(text, docs[-1][1].lower()) <= math.floor(0.2 * len(text))
    hits = decontaminate.benchmark_hits(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for odd in (0, 1):
        for words in range(3):
            got = [[h.item_id for h in r.hits] == [r.doc_id] for r in hits if r.doc_id % 2 == odd and r.doc_id % 3 == words]
            assert sum(got) >= 0.9 * len(got), (odd, words, sum(got), len(got))


def test_decontamination_corner_cases(spark, odd):
    items = spark.createDataFrame([(None, "one two three four five six"), (1, None), (2, ""), (3, "one")], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame([(50, "x ONE  two\nthree four five six", None, None, None, None)], DOCS))
    got = decontaminate.benchmark_hits(docs, items).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in got if r.hits} == {50: [None, 3], 7: [3], 8: [3]}
    assert all(not r.hits for r in decontaminate.benchmark_hits(docs, empty(items)).collect())


def test_line_dedup_of_odd_tables(spark, odd):
    """Short lines on many sites, repeated rows, very long texts, columns with the names of results."""
    rows = [(k, f"Menu\nown line {k}\nGo on", "en", f"s{k}", 9, "x") for k in range(6)] + [(9, "Menu\n" + "y " * 200_000 + "\nGo on", "en", "s9", 1, "x")]
    docs = odd.unionByName(spark.createDataFrame(rows + rows[:1], DOCS)).withColumns({"n_lines": F.lit(77), "emptied": F.lit("z")})
    got = line_spread.remove_shared_lines(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    homes = [k for k in range(6) if by[k][-1].text.startswith("Menu")]
    assert len(homes) == 1, "a shared line stays in its first place"
    assert all(r.text == f"own line {k}" for k in range(6) if k not in homes for r in by[k] if r.source == f"s{k}")
    assert by[9][-1].text == "y " * 200_000 and by[9][-1].n_removed == 2 and by[9][-1].n_lines == 3
    assert {r.n_lines for r in got if r.text is None} == {0}


def test_short_items_and_scripts_without_blanks(spark):
    rng = random.Random(8)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    thai = "".join(chr(0xE01 + rng.randrange(45)) for _ in range(50))
    rare = "".join(chr(0x20000 + rng.randrange(3000)) for _ in range(30))
    items = [(1, "Who wrote Faust?"), (2, han), (3, thai), (4, "\u4f60\u597d\u5417"), (5, rare), (6, "alpha beta")]
    edited = han[:20] + "\u4e00" + han[21:40] + han[42:]
    docs = [(1, "so: who  WROTE\nfaust? asks"), (2, "\u3042" * 30 + edited + "\u3044" * 30), (3, "x " + thai + " y"), (4, "\u6211\u8bf4\u4f60\u597d\u5417\u4e86"),
            (5, "before" + rare + "behind"), (6, "gamma alpha beta"), (7, "alpha gamma beta who"), (8, han[:30])]
    got = decontaminate.benchmark_hits(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: [h.item_id for h in r.hits] for r in got} == {**{k: [k] for k in range(1, 7)}, 7: [], 8: []}
    assert {r.doc_id: r.hits[0].distance for r in got if r.hits} == {1: 0, 2: 3, 3: 0, 4: 0, 5: 0, 6: 0}


# --- quality

def test_probabilities_sum_to_one_with_backoff(spark):
    model = perplexity.Tables(spark.createDataFrame([("abcab cabab",), ("bbca",)], "text string"))
    letters = [32, *map(ord, "abc")]
    for context in ("  a", "cab", "zzz"):
        high = sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context))
        keys = spark.createDataFrame([(high | c,) for c in letters], "key long")
        total = sum(r.p for r in model.probabilities(keys).collect())
        assert 0.5 < total <= 1.0001


def test_joined_and_broadcast_ngrams_give_the_same_perplexity(spark, odd):
    docs = odd.select("doc_id", "text")
    trusted = docs.where("doc_id in (1, 6)")
    by = [{(r.doc_id, r.t1): r.perplexity for r in perplexity.perplexities(docs, trusted, rarest).collect()} for rarest in (0, 1e-3, 1)]
    for k, p in by[0].items():
        for other in by[1:]:
            assert (p is None) == (other[k] is None) and (p is None or math.isclose(p, other[k], rel_tol=1e-9))
    assert by[0][9, next(t for d, t in by[0] if d == 9)] > by[0][1, next(t for d, t in by[0] if d == 1)]


def test_perplexity_is_that_of_plain_kneser_ney(spark, prose):
    rng = random.Random(4)
    texts = [prose(rng.randint(1, 80)) for _ in range(12)] + ["  One\n\ttwo  ", "\U00020020\U0001f600 x", "xx" * 400]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + ["zq \U00020021 ## never seen", prose(200)[::-1]])], "doc_id long, text string")
    p = brute.kneser_ney(texts[:9] + texts[-3:])
    trusted = docs.where("doc_id < 9 or doc_id between 12 and 14")
    for rarest in (0, 3e-3, 1):
        for r in perplexity.perplexities(docs, trusted, rarest).collect():
            text = docs.where(F.col("doc_id") == r.doc_id).first().text
            assert math.isclose(r.perplexity, brute.perplexity(p, text), rel_tol=1e-9), (rarest, r.doc_id)


def test_threshold_is_the_exact_quantile(spark, prose):
    rng = random.Random(6)
    rows = [(k, prose(rng.randint(3, 60)), "en" if k % 3 else None) for k in range(90)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = perplexity.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, share=0.9).collect()
    for lang in ("en", None):
        own = sorted(r.perplexity for r in got if r.doc_id < 60 and ("en" if r.doc_id % 3 else None) == lang)
        limit = own[math.ceil(0.9 * len(own)) - 1]
        assert {r.threshold for r in got if ("en" if r.doc_id % 3 else None) == lang} == {limit}


def test_quality_corner_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 1, 0), (7, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = perplexity.quality(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(r.perplexity is None and not r.kept for r in got if r.doc_id in (3, 4, 5))
    assert all(r.kept for r in got if r.doc_id == 1)
    assert all(r.perplexity is None for r in perplexity.quality(odd, empty(labels)).collect())
    assert perplexity.quality(empty(odd), labels).count() == 0


# --- top-k

def test_nearest_codes_are_exact(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 40))
    vectors[200:300] = vectors[0]  # a group of equal vectors
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(None, [1.0] * 40), (900, None), (1000, [float("nan"), None, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {}
    for r in topk.nearest(df, topk.sampled_queries(df)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))

    def code(v):
        v = list(v) + [None] * (48 - len(v))
        return [x is not None and not math.isnan(x) and x > 0 for x in v]

    codes = [(i if i is not None else 2**63, code(v)) for i, v in rows if v is not None]
    assert set(got) == {0, 100, 200, 300, 1000}
    for q, found in got.items():
        own = dict(codes)[q]
        best = sorted((sum(a != b for a, b in zip(own, c)), i) for i, c in codes)[:10]
        assert sorted(found, key=lambda x: x[0]) == [(k + 1, i if i < 2**63 else None, d) for k, (d, i) in enumerate(best)]
    assert topk.nearest(empty(df), empty(df)).count() == 0


def test_frequent_ngrams_are_broadcast_up_to_a_number(spark):
    """However large a model is, as many of its n-grams are broadcast; rows of one weight go together."""
    table = spark.range(1, 101).select(F.col("id").alias("key"), F.floor((F.col("id") + 1) / 2).alias("n"), F.lit(0.5).alias("p"))
    keys = lambda rarest: perplexity._head(table, "p", "n", rarest)[0].tolist()
    assert keys(1 / 40) == list(range(61, 101)) and keys(1 / 41) == keys(1 / 40)
    assert keys(1e-6) == keys(0) == list(range(1, 101)) and keys(1) == []


def test_broadcast_tables_are_not_held_as_bytes_too(spark, prose, monkeypatch):
    """Workers and driver hold the arrays of a model, not a pickled copy beside them."""
    sent, whole = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(value) or whole(self, value))
    docs = spark.createDataFrame([(k, prose(20), "en") for k in range(12)], "doc_id long, text string, lang string")
    assert langid.identify(docs).count() == 12
    assert sent and not any(isinstance(value, bytes) for value in sent)


def test_a_model_is_broadcast_once_and_compressed(spark, prose, monkeypatch):
    """The driver keeps one copy for calibration and decisions, of about the size of what is set in the bitmap."""
    sent, whole = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or whole(self, value))
    docs = spark.createDataFrame([(k, prose(20), "en") for k in range(40)], "doc_id long, text string, lang string")
    models = langid.train(docs.select("text", "lang"))
    once = sorted(map(tuple, langid.decisions(docs, models).collect()))
    assert len(sent) == 1 and sent[0] < (1 << perplexity.BITS) // 8 // 4
    assert sorted(map(tuple, langid.decisions(docs, models).collect())) == once and len(sent) == 2


def test_bitmaps_are_exact_and_few_keys_are_few_bytes(spark):
    """Pages with few bits move as places; pages of many bits, and pages that several tasks share, are whole."""
    batch = lambda keys, kind: pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "kind": np.full(len(keys), kind, np.int32)})
    few = [r for b in perplexity._pages([batch(np.arange(900, dtype=np.uint64), 5)]) for r in b.to_pylist()]
    assert sum(len(r["bits"]) for r in few) <= 2 * 900
    # Of the keys tried, some 4,900 share one page: more than it has as places.
    tried = np.arange(20_000_000, dtype=np.uint64)
    tried = np.concatenate([tried[perplexity.bits_of(tried, 2) // np.uint64(perplexity._PAGE) == 7], tried[:500]])
    assert max(len(r["bits"]) for b in perplexity._pages([batch(tried, 2)]) for r in b.to_pylist()) == perplexity._PAGE // 8
    both = [(2, tried), (3, np.arange(2**64 - 3000, 2**64 - 1, dtype=np.uint64))]
    tables = [(k, spark.createDataFrame(pa.table({"key": keys.view(np.int64)})).repartition(3)) for k, keys in both]
    want = np.zeros(1 << perplexity.BITS, bool)
    for k, keys in both:
        want[perplexity.bits_of(keys, k)] = True
    assert (perplexity.bitmap(tables) == np.packbits(want)).all()
    assert not perplexity.bitmap([(1, empty(tables[0][1]))]).any()


def test_models_use_one_set_of_python_workers(spark, prose, monkeypatch):
    """n-grams that are looked up go to Spark as Arrow data: rows of Python would start workers that nothing else uses."""
    sent, whole = [], SparkContext.parallelize
    docs = spark.createDataFrame([(prose(20), "en") for _ in range(40)], "text string, lang string")
    usual = langid.train(docs)["en"].random
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a: sent.append(a) or whole(self, *a))
    assert langid.train(docs, head=5)["en"].random == pytest.approx(usual) and not sent


def test_trusted_texts_are_exact_and_hardly_move(spark):
    """Only what both bitmaps have is joined: ids that share a bit with trusted ones, and trusted ones that share one with these."""
    docs = spark.createDataFrame(
        [(k % 4000, f"text {k}") for k in range(5000)] + [(None, "none"), (3, None), (-7, "below")], "doc_id long, text string")
    good = spark.createDataFrame([(k,) for k in range(0, 4000, 3)] + [(-7,), (9999,)], "doc_id long")
    want = sorted([(k % 4000, f"text {k}") for k in range(5000) if k % 4000 % 3 == 0] + [(-7, "below")])
    found = perplexity.trusted_texts(docs, good)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Union") < plan.index("Join")
    every, none = (SimpleNamespace(value=np.full((1 << perplexity.BITS) // 8, x, np.uint8)) for x in (255, 0))
    batch = pa.RecordBatch.from_pydict({"key": np.arange(9)})
    rows = lambda *a: sum(b.num_rows for b in perplexity._members([batch], *a))
    assert [rows([every]), rows([none])] == [9, 0]
    assert [rows([every, x], last) for x in (every, none) for last in (True, False)] == [9, 0, 0, 9] and rows([none, every]) == 0


# --- near-duplicates

def test_near_duplicates_are_those_of_all_pairs(spark, prose):
    rng = random.Random(9)
    rows = []
    for g in range(25):
        base = prose(rng.randint(1, 150)).split()
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(["new", "other", "third", "Fourth"])
            rows.append(" ".join(copy) if rng.random() < 0.5 else "\n".join(copy).upper())
    rng.shuffle(rows)
    rows = [(k, t) for k, t in enumerate(rows)] + [(500, None), (501, ""), (502, " "), (None, rows[0]), (3, rows[3])]
    for share, n, bands, per in (((85, 100), 3, 36, 7), ((80, 100), 5, 51, 5)):
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=n, share=share, bands=bands, rows=per)
        assert Counter(map(tuple, got.collect())) == Counter(brute.near_duplicates(rows, n, share))


def test_links_that_no_hub_sees(spark, prose, monkeypatch):
    """A chain: members of one bucket that are linked with each other but not with its least member."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    words = prose(120).split()
    rows = []
    for k in range(18):
        changed = list(words)
        for j in range(k):
            changed[6 * j] = f"w{j}"
        rows.append((100 - k, " ".join(changed)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute.near_duplicates(rows))


def test_unlinked_near_copies_are_not_held_against_each_other(spark, prose, monkeypatch):
    """A family that shares buckets, but whose sets differ too much: no group of candidates grows with it."""
    words = prose(150).split()
    rng = random.Random(4)
    rows = []
    for k in range(60):
        changed = list(words)
        for j in rng.sample(range(150), 9):
            changed[j] = f"w{k}x{j}"
        rows.append((k, " ".join(changed)))
    rows += [(100 + k, f"{rows[k][1]} end") for k in range(0, 60, 7)]
    seen = []
    whole = neardup.cross_links
    monkeypatch.setattr(neardup, "cross_links", lambda members, *a, **b: seen.append(members) or whole(members, *a, **b))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(brute.near_duplicates(rows))
    assert max((r["count"] for r in seen[0].groupBy("key").count().collect()), default=0) <= 6


def test_densified_bins_agree_for_equal_sets():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, (20, neardup.BINS)).astype(np.uint64)
    filled = rng.random((20, neardup.BINS)) < np.linspace(0.004, 1, 20)[:, None]
    filled[0] = False
    out = neardup.densify(values, filled, neardup.sequences())
    for k in range(1, 20):
        if filled[k].any():
            assert set(out[k]) <= set(values[k][filled[k]])
            assert (out[k][filled[k]] == values[k][filled[k]]).all()


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- WARC

def test_archives_round_trip(spark):
    pages = [(5, "http://a/x y", "<p>é</p>"), (2, None, None), (7, "http://b", ""), (9, "http://c", "WARC/1.1\r\n\r\nx\r\n\r\n"),
             (1, "http://d", "<p>é</p>"), (1, "http://d", "<p>é</p>"), (None, "http://e", "only"), (12, "u" * 5000, "z" * 300_000)]
    arcs = spark.createDataFrame(pages, "page_id long, url string, html string").mapInArrow(warc.pages_to_arc, "path string, content binary")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(warc.to_warc(arcs), path)
    got = warc.resolved(warc.read_warc(spark, path)).collect()
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        first = min((p for p, _, h in pages if p is not None and (h or "") == (html or "")), default=None)
        same = page == first
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else first))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)


def test_both_arc_versions_are_parsed():
    for version, line in ((1, b"http://h/a b 1.2.3.4 20010203040506 text/html 5\n"), (2, b"http://h/a b 1.2.3.4 20010203040506 text/html 404 abc - 99 f.arc 5\n")):
        content = warc._arc_block(version, "f.arc") + line + b"ab\ncd\n" + line + b"12345\n"
        records = list(warc.arc_records(content))
        assert [(h["URL"], h["Archive-date"], b) for h, b in records] == [("http://h/a b", "20010203040506", b"ab\ncd"), ("http://h/a b", "20010203040506", b"12345")]
    with pytest.raises(ValueError):
        list(warc.arc_records(warc._arc_block(1, "f") + b"http://h 1.2.3.4 20010203040506 text/html 50\nshort\n"))


def test_bytes_and_types_of_records_are_kept(spark):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: x\r\nContent-Length: 3\r\n\r\n"
    blocks = {"http://latin": http + "caf\u00e9 \u00fc".encode("latin-1"), "http://png": http + bytes(range(256)), "http://lf": b"HTTP/1.0 200 OK\nA: b\n\nbody\xff",
              "http://head": b"HTTP/1.0 204 No\r\nA: \xe9\r\n\r\n", "dns:a.b": b"20200101\nA.B. 1 IN A 1.2.3.4\n"}
    content = warc._arc_block(1, "f.arc") + b"".join(
        f"{url} 1.2.3.4 20010203040506 {'text/dns' if url[0] == 'd' else 'text/html'} {len(b)}\n".encode() + b + b"\n" for url, b in blocks.items())
    path = scratch_path(spark, "warc-bytes")
    warc.write_warc(warc.to_warc(spark.createDataFrame([("f.arc", bytearray(content))], "path string, content binary")), path)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    records = [x for f in files for x in warc.warc_records(f)]
    assert {h["warc-target-uri"]: b for h, b in records if "warc-target-uri" in h} == blocks
    assert sorted((h["warc-type"], h["content-type"]) for h, _ in records) == [
        ("resource", "text/dns"), *[("response", "application/http;msgtype=response")] * 4, ("warcinfo", "text/plain")]
    assert {r.url: r.payload_bytes for r in warc.read_warc(spark, path).collect()} == {
        "http://latin": 6, "http://png": 256, "http://lf": 5, "http://head": 0, "dns:a.b": len(blocks["dns:a.b"])}
    import gzip

    import pyarrow as pa
    plain = b"".join(gzip.decompress(f) for f in files).replace(b"body\xff", b"bodyX")
    with pytest.raises(ValueError):
        list(warc._read(iter([pa.RecordBatch.from_arrays([pa.array([plain])], ["content"])])))
