"""Benchmark passages in documents, found by CGK embeddings and bit-sampling LSH, verified by edit distance.

The CGK embedding walks over a word sequence: at step j it emits the current word and moves on if the j-th random
function of that word says so. Two sequences at a small edit distance fall into step again after an edit, so
their embeddings have a small Hamming distance. A repetition draws its own random functions and some steps; the
words emitted at these are the LSH key. Windows are item-sized: the walk is the
longest of WALKS within half the item, each item is indexed at every word pair from which it stays inside, and a document's windows start where a pair of some item occurs
(a key holds the pair at its start, so other starts could match no key). How many repetitions reach the target
recall follows from the edit share, for one start; an item has as many chances as it has intact starts. A key
needs whole words, so recall is that of `repetitions` or better where some words in a row are intact, and falls where
edits touch nearly every word.

Every place that one meeting proposes is verified exactly: the least edit distance, in characters, between the item
and any part of the document that can hold it there (words in lower case with one blank between) must be at most
`share` of the item. A lower bound, the sum of the least distances of the item's blocks, spares most of these.

The benchmark is broadcast in blocks of at most `block_bytes`, whatever its size; a document is read once.
In scripts without blanks each character counts as a word, but isn't set apart for the edit distance. Items of fewer
than MIN_WORDS words have no walk; each pair of their words is a key, or the word where it is only one, so exact copies are always
found. Null or empty texts hold no item, null items and items without words are never found. Repeated items are all reported. A null
item_id is reported as null; item ids are numbers (long), another kind ends the job.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import column_bytes, mix, slices, word_hasher

MIN_WORDS = 5
WALKS = (4, 8, 16, 32)  # steps of a walk; the longest within half the item is used
SAMPLES = 3
PAIRS = (-1, -1)  # place in the index of the word pairs of short items
WORDS = (-2, -1)  # and of items that are one word
BLOCK = 64  # characters of an item that are compared at once


def repetitions(recall: float, share: float) -> int:
    """Repetitions until one start of an item is found with the target recall: an edit costs about two steps."""
    agree = max(1 - 2 * share, 0.1) ** SAMPLES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _steps(reps: int) -> list[list[set[int]]]:
    """The sampled steps by repetition and walk, the same in every task; steps 0 and 1 stay in the pair at the start."""
    rng = np.random.default_rng(7)
    return [[set(rng.choice(np.arange(2, w), min(SAMPLES, w - 2), replace=False).tolist()) for w in WALKS] for _ in range(reps)]


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """One hash per word: of it and the next."""
    return mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) if len(h) > 1 else h[:0]


def walk_keys(h: np.ndarray, starts: np.ndarray, longest: int, rep: int, steps: list) -> dict[int, np.ndarray]:
    """LSH keys of the windows at `starts`, by walk; positions beyond the last word repeat it."""
    at, last = starts.copy(), len(h) - 1
    pair = mix(h[starts] * np.uint64(0xD6E8FEB86659FD93) + h[np.minimum(starts + 1, last)])
    keys = {k: mix(pair + np.uint64(1000 * rep + k)) for k, w in enumerate(WALKS) if w <= longest}
    for j in range(longest):
        word = h[at]
        for k in keys:
            if j < WALKS[k] and j in steps[rep][k]:
                keys[k] = mix(keys[k] * np.uint64(0x9E3779B97F4A7C15) + word)
        # bit j of a hash of the word: one random function per step and repetition
        at = np.minimum(at + ((word * np.uint64(2 * rep + 3) >> np.uint64(20 + j)) & np.uint64(1)).astype(np.int64), last)
    return keys


def edit_distance_within(item: str, text: str) -> int:
    """Least edit distance between the item and any substring of text (bit-parallel columns)."""
    m = len(item)
    match: dict[str, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    least = m
    for c in text:
        eq = match.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = (down | ~(x | up)) & full, up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full  # a match may start anywhere: no carry-in
        v = eq | down
        up, down = (minus | ~(v | plus)) & full, plus & v
        least = min(least, score)
    return least


def may_match(item: str, text: str, edits: int) -> bool:
    """Whether text holds as many of the item's q-grams as a substring within `edits` must (q edits lose q each)."""
    for q in (3, 4):
        need = len(item) - q + 1 - edits * q
        if need > 0:
            seen = {text[i: i + q] for i in range(len(text) - q + 1)}
            if sum(item[i: i + q] in seen for i in range(len(item) - q + 1)) < need:
                return False
    return True


def _plain(data: bytes) -> str:
    """Lower-case words with one blank between, words as in `arrays`."""
    return b" ".join(data.translate(_FOLD).split()).decode("utf-8", "replace")


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def build_index(items: list[tuple[object, str]], share: float, recall: float) -> dict:
    """Sorted key arrays per repetition and walk, and what verification needs."""
    words, reps = word_hasher(units=True), repetitions(recall, share)
    steps = _steps(reps)
    kept, parts, pairs, places = [], {}, [], []
    for item_id, text in items:
        h, first, end, _ = words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        if not len(h):
            continue
        n = len(kept)
        if len(h) == 1:
            kept.append((item_id, _plain(text.encode()), 1))
            places.append(np.zeros(1, np.int64))
            parts.setdefault(WORDS, []).append((h, np.full(1, n), np.zeros(1, np.int64)))
            continue
        short = len(h) < MIN_WORDS
        k = max(k for k, w in enumerate(WALKS) if w <= max(len(h) / 2, WALKS[0]))
        starts = np.arange(len(h) - 1 if short else len(h) - WALKS[k] + 1)
        raw = np.frombuffer(text.encode(), np.uint8)
        kept.append((item_id, _plain(text.encode()), len(h)))
        places.append(_positions(raw, first, end))
        pairs.append(pair_hashes(h)[starts])
        if short:
            parts.setdefault(PAIRS, []).append((pair_hashes(h), np.full(len(starts), n), starts))
        for rep in range(0 if short else reps):
            keys = walk_keys(h, starts, WALKS[k], rep, steps)[k]
            parts.setdefault((rep, k), []).append((keys, np.full(len(starts), n), starts))
    index = {}
    for where, rows in parts.items():
        key, item, start = (np.concatenate(x) for x in zip(*rows))
        order = np.argsort(key, kind="stable")
        index[where] = (key[order], item[order], start[order])
    every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
    sieve = np.zeros(1 << 20, bool)
    sieve[(every >> np.uint64(44)).astype(np.int64)] = True
    at = np.concatenate(places) if places else np.zeros(0, np.int64), np.cumsum([0, *map(len, places)])
    return {"items": kept, "at": at, "index": index, "pairs": every, "sieve": sieve, "reps": reps, "share": share}


def _hits(column: pa.Array, found: dict, words: Callable, steps: list) -> list[list[dict]]:
    data, offsets = column_bytes(column)
    h, first, end, counts = words(data, offsets)
    out: list[list[dict]] = [[] for _ in counts]
    if not len(h) or not found["items"]:
        return out
    row = np.repeat(np.arange(len(counts)), counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    pairs = pair_hashes(h)
    starts = np.flatnonzero(found["sieve"][(pairs >> np.uint64(44)).astype(np.int64)])
    starts = starts[row[starts] == row[starts + 1]] if len(starts) else starts
    if len(starts):
        place = np.minimum(np.searchsorted(found["pairs"], pairs[starts]), len(found["pairs"]) - 1)
        starts = starts[found["pairs"][place] == pairs[starts]]
    candidates = []
    longest = max((WALKS[k] for _, k in found["index"] if k >= 0), default=0)
    for rep in range(-1, found["reps"]) if len(starts) else ():
        keys = walk_keys(h, starts, longest, rep, steps) if rep >= 0 else {-1: pairs[starts]}
        for k in keys:
            if (rep, k) not in found["index"]:
                continue
            known, item, at = found["index"][rep, k]
            lo, hi = np.searchsorted(known, keys[k], "left"), np.searchsorted(known, keys[k], "right")
            n = hi - lo
            if n.any():
                which = np.repeat(np.arange(len(starts)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                candidates.append(np.stack([starts[which], item[place], at[place]], 1))
    if WORDS in found["index"]:
        known, item, at = found["index"][WORDS]
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(h)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        candidates.append(np.stack([which, item[place], at[place]], 1))
    if not sum(map(len, candidates)):
        return out
    met = np.unique(np.concatenate(candidates), axis=0)
    texts, base, at = _plain_rows(data, first, end, bounds, np.unique(row[met[:, 0]]))
    sizes = np.array([len(x[1]) for x in found["items"]])
    edits = np.floor(found["share"] * sizes).astype(np.int64)
    item_at, item_base = found["at"]
    item = met[:, 1]
    begin = at[met[:, 0]] - item_at[item_base[item] + met[:, 2]]  # of the item in the plain text, if nothing before is edited
    docs = row[met[:, 0]]
    order = np.lexsort((begin, docs, item))
    docs, item, begin, word = docs[order], item[order], begin[order], (met[:, 0] - met[:, 2])[order]
    # places of one document and item whose begins are within `edits` are looked at together
    head = _runs(item * len(counts) + docs, begin, edits[item])
    last = np.append(head[1:], len(begin)) - 1
    docs, item, low, high, word = docs[head], item[head], begin[head], begin[last], word[head]
    if "masks" not in found:
        found["masks"] = _masks(found["items"])
    low, span = low - edits[item], high - low
    codes = np.concatenate([_codes(t) for t in texts.values()])
    likely = _near_enough(codes, item, base[docs] + low, span, sizes, edits, *found["masks"])
    high = low + span + sizes[item] + 2 * edits[item]
    low, high = np.maximum(low, 0), np.maximum(high, 0)
    done = set()
    for doc, i, a, b, w in sorted(zip(*(x[likely].tolist() for x in (docs, item, low, high, word)))):
        if (doc, i) in done:
            continue
        (item_id, plain, _), most, text = found["items"][i], int(edits[i]), texts[doc][a:b]
        distance = edit_distance_within(plain, text) if may_match(plain, text, most) else len(plain)
        if distance <= most:
            done.add((doc, i))
            out[doc].append({"item_id": item_id, "distance": distance, "place": int(max(w, bounds[doc]) - bounds[doc])})
    return out


def _positions(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where each word begins in the plain text of all of them, in characters."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n = chars[end] - chars[first]
    gap = np.concatenate([[False], first[1:] > end[:-1]])
    return np.cumsum(n) - n + np.cumsum(gap)


def _plain_rows(data, first, end, bounds, rows) -> tuple[dict[int, str], np.ndarray, np.ndarray]:
    """Plain texts of the rows, where each begins when they are joined, and each word's place in its row's text."""
    texts = {r: _plain(data[first[bounds[r]]: end[bounds[r + 1] - 1]].tobytes()) for r in rows.tolist()}
    at = np.zeros(len(first), np.int64)
    for r in texts:
        a, b = bounds[r], bounds[r + 1]
        at[a:b] = _positions(data[first[a]: end[b - 1]], first[a:b] - first[a], end[a:b] - first[a])
    base = np.zeros(len(bounds) - 1, np.int64)
    base[rows] = np.cumsum([0, *map(len, texts.values())])[:-1]
    return texts, base, at


def _runs(group: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Heads of runs in sorted rows: a run is of one group, and its begins are at most `width` behind the head's."""
    heads = np.concatenate([[True], (group[1:] != group[:-1]) | (begin[1:] - begin[:-1] > width[1:])])
    while True:
        head = np.maximum.accumulate(np.where(heads, np.arange(len(begin)), 0))
        far = begin - begin[head] > width
        first = far & ~np.concatenate([[False], far[:-1] & (head[1:] == head[:-1])])
        if not first.any():
            return np.flatnonzero(heads)
        heads |= first


def _masks(items: list) -> tuple[np.ndarray, np.ndarray]:
    """For each BLOCK characters of each item, the bits of its places by low byte of the character; an item's first block."""
    first = np.cumsum([0, *(-(-len(x[1]) // BLOCK) for x in items)])
    out = np.zeros((first[-1], 256), np.uint64)
    for n, x in enumerate(items):
        code = _codes(x[1])
        place = np.arange(len(code))
        np.bitwise_or.at(out, (first[n] + place // BLOCK, code), np.uint64(1) << (place % BLOCK).astype(np.uint64))
    return out, first


def _codes(text: str) -> np.ndarray:
    return (np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) & 0xFF).astype(np.int64)


def _near_enough(codes, item, low, span, sizes, edits, masks, first, most: int = 1 << 12) -> np.ndarray:
    """Whether the blocks of the item, each found where it may be by itself, need at most `edits` edits in sum: no
    more than the item as a whole. Equal low bytes and what is read beyond a text only make the sum smaller."""
    out = np.ones(len(item), bool)
    one, eqs = np.uint64(1), masks.reshape(-1)
    before, after = max(0, -int(low.min(initial=0))), int((low + sizes[item] + 2 * edits[item] + span).max(initial=0)) + BLOCK
    codes = np.concatenate([np.zeros(before, np.int64), codes, np.zeros(max(0, after - len(codes)) + 2 * int(edits.max(initial=0)) + int(span.max(initial=0)), np.int64)])
    # alike in how many characters are read, so that few are read in vain
    order = np.argsort(2 * edits[item] + span, kind="stable")
    for c in range(0, len(item), most):
        left = order[c: c + most]
        total = np.zeros(len(left), np.int64)
        for block in range(int(-(-sizes[item[left]].max() // BLOCK))):
            there = block * BLOCK < sizes[item[left]]
            left, total = left[there], total[there]
            if not len(left):
                break
            i = item[left]
            length = np.minimum(sizes[i] - block * BLOCK, BLOCK)
            at, top = (first[i] + block) * 256, (length - 1).astype(np.uint64)
            # bits above a block's last never reach those below, so they need no mask
            up, down = np.full(len(left), ~np.uint64(0)), np.zeros(len(left), np.uint64)
            score, least, start = length.copy(), length.copy(), before + low[left] + block * BLOCK
            eq, x, plus, minus = (np.empty(len(left), np.uint64) for _ in range(4))
            for step in range(int((length + 2 * edits[i] + span[left]).max())):
                np.take(eqs, at + codes[start + step], out=eq)
                np.bitwise_and(eq, up, out=x)
                x += up
                x ^= up
                x |= eq
                x |= down
                np.bitwise_and(up, x, out=minus)
                np.bitwise_or(x, up, out=plus)
                np.invert(plus, out=plus)
                plus |= down
                eq |= down
                score += (plus >> top & one).view(np.int64)
                score -= (minus >> top & one).view(np.int64)
                plus <<= one
                minus <<= one
                np.bitwise_and(plus, eq, out=down)
                np.bitwise_or(eq, plus, out=up)
                np.invert(up, out=up)
                up |= minus
                np.minimum(least, score, out=least)
            total = total + least
            near = total <= edits[i]
            out[left[~near]] = False
            left, total = left[near], total[near]
    return out


def _finder(spark, index: dict) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(index))
    kind = "array<struct<item_id:long, distance:int, place:int>>"

    @F.arrow_udf(kind)
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found, words = pickle.loads(shared.value), word_hasher(units=True)
        steps = _steps(found["reps"])
        arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("place", pa.int32())]))
        for column in columns:
            rows = []
            for part in slices([pa.RecordBatch.from_arrays([column], ["text"])], "text"):
                rows += _hits(part.column("text"), found, words, steps)
            yield pa.array(rows, arrow)

    return find.asNondeterministic()


def benchmark_hits(docs: DataFrame, items: DataFrame, out: str = "hits", share: float = 0.2, recall: float = 0.95,
                   block_bytes: int = 4 << 20) -> DataFrame:
    """docs with `out`: array<struct<item_id, distance, place>>, one for each item that a document holds."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / block_bytes))
    parts = []
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        find = _finder(docs.sparkSession, build_index([(r.item_id, r.text) for r in block], share, recall))
        docs = docs.withColumn(f"_hits{k}", find(F.col("text")))
        parts.append(f"_hits{k}")
    return docs.withColumn(out, F.array_sort(F.flatten(F.array(*parts)))).drop(*parts)
