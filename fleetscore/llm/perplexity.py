"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts character 4-grams (case, digits and marks count as they are, white space is one blank), packed
into 64 bits. Each task counts its own first; the sums, the continuation counts of the lower orders, the three
discounts of each order and the contexts' totals are grouped and joined as tables sharded by n-gram.

A text's perplexity needs the probabilities of its n-grams. The 1 / rarest most frequent n-grams and contexts of
each order, less those as frequent as the first one left out, are broadcast, and so is a bitmap of fixed size with a bit for
each n-gram and context of the model. A task finds what is in the broadcast tables, and backs off where the bitmap says for sure that an
n-gram or context was never seen. What may be in the model but isn't broadcast is looked up by joins: such n-grams are counted
per document, their distinct keys joined with the sharded tables order by order, backing off where an order lacks one, and the
sums joined to the documents. Nothing is pruned: every n-gram gets its full interpolated probability.

A language's threshold is the exact quantile of the perplexities of its trusted documents, or of all trusted documents
where it has none. Null texts and texts without characters have no perplexity and aren't kept. A null
language is a group of its own. Labels: a document is trusted if any of its labels has quality 1 and none is toxic.
Without trusted text no document has a perplexity. Rows equal in doc_id and text have equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.llm.arrays import column_bytes, mix, narrow, settle, slices, text_key
from fleetscore.llm.running import quantiles

ORDER = 4
BITS = 27  # a bitmap of 2 ** BITS bits tells which n-grams a model may have
_PAGE = 1 << 15  # bits of a page of it
_BLANK = np.uint64(32)


def _mask(k: int) -> int:
    return (1 << (16 * k)) - 1 if k < ORDER else -1


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """4-gram keys of all rows in order, and how many each row has; each row begins after three blanks."""
    data, offsets = column_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = narrow(points)
    solid = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    after = np.zeros(len(codes), bool)
    after[1:] = solid[:-1]
    after[ends[:-1][ends[:-1] < len(codes)]] = False
    kept = np.flatnonzero(solid | after)
    counts = np.diff(np.searchsorted(kept, ends))
    row = np.repeat(np.arange(len(counts)), counts)
    line = np.full(len(kept) + (ORDER - 1) * len(counts), _BLANK, np.uint64)
    at = np.arange(len(kept)) + (ORDER - 1) * (row + 1)
    line[at] = np.where(solid[kept], codes[kept], _BLANK)
    keys = line[at].copy()
    for k in range(1, ORDER):
        keys |= line[at - k] << np.uint64(16 * k)
    return keys, counts


def _count(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, np.uint64), np.zeros(0))

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1].astype(np.int64))], ["key", "n"])

    for batch in slices(batches, "text"):
        own = np.sort(grams(batch.column("text"))[0])
        if len(own):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            keys, place = np.unique(np.concatenate([held[0], own[first]]), return_inverse=True)
            held = keys, np.bincount(place, np.concatenate([held[1], np.diff(np.append(first, len(own)))]))
        if len(held[0]) > most:
            yield rows()
            held = (held[0][:0], held[1][:0])
    yield rows()


def _order(counts: DataFrame, lower: DataFrame | None, k: int, base: float) -> tuple[DataFrame, DataFrame]:
    """(grams: key, p; contexts: key, gamma) of one order, from its counts and the order below."""
    n1, n2, n3, n4 = counts.agg(*[F.count_if(F.col("n") == c) for c in (1, 2, 3, 4)]).first()
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    steps = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    d1, d2, d3 = (min(max(d, 0.05), c - 0.05) for c, d in enumerate(steps, 1))
    discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
    context = F.shiftrightunsigned("key", 16)
    contexts = settle(counts.groupBy(context.alias("context")).agg(
        F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("gamma")), f"contexts{k}")
    rows = counts.withColumn("context", context).join(contexts, "context").withColumn("suffix", F.col("key").bitwiseAND(F.lit(_mask(k - 1))))
    if lower is None:
        rows = rows.withColumn("below", F.lit(base))
    else:
        rows = rows.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix")
    p = (F.col("n") - discount) / F.col("total") + F.col("gamma") * F.col("below")
    return settle(rows.select("key", "n", p.alias("p")), f"grams{k}"), contexts.select(F.col("context").alias("key"), "gamma", "total")


class Tables:
    """The sharded tables of a model: grams[k - 1] (key, n, p) and contexts[k - 1] (key, gamma) of order k."""

    def __init__(self, trusted: DataFrame):
        counts = [settle(trusted.where("text is not null").select("text").mapInArrow(_count, "key long, n long")
                         .groupBy("key").agg(F.sum("n").alias("n")), "counts")]
        for k in range(ORDER - 1, 0, -1):
            counts.append(counts[-1].groupBy(F.col("key").bitwiseAND(F.lit(_mask(k))).alias("key")).agg(F.count("*").alias("n")))
        alphabet = counts[-1].count()
        self.known = alphabet > 0
        self.base = 1 / (alphabet + 1)  # a character that was never seen shares the alphabet's rest
        self.grams: list[DataFrame] = []
        self.contexts: list[DataFrame] = []
        for k in range(1, ORDER + 1):
            g, c = _order(settle(counts[-k], f"order{k}"), self.grams[-1] if self.grams else None, k, self.base)
            self.grams.append(g)
            self.contexts.append(c)

    def probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, p) for every distinct 4-gram key, seen or not."""
        out = keys.select("key").distinct().withColumn("p", F.lit(None).cast("double")).withColumn("back", F.lit(1.0))
        for k in range(ORDER, 0, -1):
            own = F.col("key").bitwiseAND(F.lit(_mask(k)))
            seen = self.grams[k - 1].select(F.col("key").alias("_k"), F.col("p").alias("_p"))
            weights = self.contexts[k - 1].select(F.col("key").alias("_c"), F.col("gamma").alias("_g"))
            out = out.withColumn("_own", own).join(seen, F.col("_own") == F.col("_k"), "left").withColumn(
                "_context", F.shiftrightunsigned("_own", 16)).join(weights, F.col("_context") == F.col("_c"), "left").select(
                "key", F.coalesce("p", F.col("back") * F.col("_p")).alias("p"),
                (F.col("back") * F.coalesce("_g", F.lit(1.0))).alias("back"))
        return out.select("key", F.coalesce("p", F.col("back") * self.base).alias("p"))


def bits_of(keys: np.ndarray, kind: int) -> np.ndarray:
    """Places in a bitmap: one bit for a key of a kind (n-gram or context of an order, document)."""
    return mix(keys ^ mix(np.full(1, kind + 1, np.uint64))) >> np.uint64(64 - BITS)


def _places(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    keys, kinds = batch.column("key").to_numpy().view(np.uint64), batch.column("kind").to_numpy()
    for kind in np.unique(kinds):
        yield bits_of(keys[kinds == kind], int(kind)).astype(np.int64)


def _set_bits(bits: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at some places; of the eight of a byte the highest is the first."""
    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page that keys of a task set bits of: places of the bits, two bytes each, or the page itself where that is less."""
    out, touched = np.zeros((1 << BITS) // 8, np.uint8), np.zeros((1 << BITS) // _PAGE, bool)
    for batch in batches:
        for at in _places(batch):
            _set_bits(out, at)
            touched[at // _PAGE] = True
    pages, out = np.flatnonzero(touched), out.reshape(-1, _PAGE // 8)
    for start in range(0, len(pages), 256):
        some = pages[start: start + 256]
        places = [np.flatnonzero(np.unpackbits(out[p])).astype(np.uint16) for p in some]
        least = [(at if at.nbytes < _PAGE // 8 else out[p]).tobytes() for p, at in zip(some, places)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(least, pa.binary())], ["page", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What tasks have of each page to one row a page, compressed."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, bits in zip(batch.column("page").to_pylist(), batch.column("bits")):
            own, data = held.setdefault(page, np.zeros(_PAGE // 8, np.uint8)), bits.as_buffer()
            if data.size < _PAGE // 8:
                _set_bits(own, np.frombuffer(data, np.uint16).astype(np.int64))
            else:
                own |= np.frombuffer(data, np.uint8)
    packed = [zlib.compress(bits, 1) for bits in held.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["page", "bits"])


class Packed:
    """A bitmap that is pickled compressed: a broadcast of it takes the driver what its set bits need, and workers get the array."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __reduce__(self):
        return _unpacked, (zlib.compress(self.bits, 1),)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def bitmap(tables: list[tuple[int | Column, DataFrame]]) -> np.ndarray:
    """The bits of all (kind, keys); the driver gathers 2 ** BITS bits at most, compressed and in four parts."""
    parts = None
    for kind, keys in tables:
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        part = keys.select("key", kind.cast("int").alias("kind")).mapInArrow(_pages, "page long, bits binary")
        parts = part if parts is None else parts.unionByName(part)
    out = np.zeros((1 << BITS) // 8, np.uint8)
    pages = parts.repartition("page").mapInArrow(_united, "page long, bits binary")
    for r in pages.repartition(4).toLocalIterator():
        out[r.page * _PAGE // 8: (r.page + 1) * _PAGE // 8] = _unpacked(r.bits)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray, kind: int) -> np.ndarray:
    at = bits_of(keys, kind)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def resolve(keys: np.ndarray, heads: dict, bits: np.ndarray, base: float, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """log p of the keys that broadcast tables and bitmap settle, and which those are.

    Of a model, n-grams of order k are of kind `kind` + k in the bitmap, their contexts of kind `kind` + ORDER + k.
    """
    out, settled = np.zeros(len(keys)), np.zeros(len(keys), bool)
    rest, back = np.arange(len(keys)), np.zeros(len(keys))
    for k in range(ORDER, 0, -1):
        own = keys[rest] & np.uint64(_mask(k) & 0xFFFFFFFFFFFFFFFF)
        seen, log = _found(heads["grams", k], own)
        out[rest[seen]] = back[rest[seen]] + log[seen]
        settled[rest[seen]] = True
        unseen = ~seen & ~maybe(bits, own, kind + k)
        context = own >> np.uint64(16)
        known, weight = _found(heads["contexts", k], context)
        on = unseen & (known | ~maybe(bits, context, kind + ORDER + k))
        back[rest[on]] += np.where(known[on], weight[on], 0.0)
        rest = rest[on]
    out[rest] = back[rest] + np.log(base)
    settled[rest] = True
    return out, settled


def _scorer(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text to a row per document (n-grams, log p of those settled here) and a row per document and other n-gram."""
    heads, bits, base = shared.value
    for batch in slices(batches, "text", 1 << 19):
        keys, counts = grams(batch.column("text"))
        row = np.repeat(np.arange(len(counts)), counts)
        unique, place = np.unique(keys, return_inverse=True)
        log, settled = resolve(unique, heads, bits, base)
        sums = np.bincount(row, log[place], len(counts)).astype(float)
        rest = np.flatnonzero(~settled[place])
        pairs, n = np.unique(np.stack([row[rest], place[rest]], 1), axis=0, return_counts=True) if len(rest) else (np.zeros((0, 2), np.int64), [])
        beside = [c for c in batch.schema.names if c not in ("text", "row")]
        names = ["row", *beside, "key", "n", "logs"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *[batch.column(c) for c in beside], pa.nulls(len(counts), pa.int64()), pa.array(counts, pa.int64()), pa.array(sums)], names)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row").take(pa.array(pairs[:, 0])), *[pa.nulls(len(pairs), batch.column(c).type) for c in beside],
             pa.array(unique[pairs[:, 1]].view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(pairs), pa.float64())], names)


def _head(table: DataFrame, value: str, weight: str, rarest: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and log values of the 1 / rarest rows of the greatest weight at most; rows of one weight go together."""
    sizes = table.groupBy(weight).agg(F.count("*").alias("rows")).toPandas().sort_values(weight, ascending=False)
    kept = sizes[weight][sizes["rows"].cumsum() <= (1 / rarest if rarest else np.inf)]
    least = int(kept.iloc[-1]) if len(kept) else 2**63 - 1
    rows = table.where(F.col(weight) >= least).select("key", F.log(value).alias("log")).toArrow()
    keys, logs = rows.column("key").to_numpy().view(np.uint64), rows.column("log").to_numpy()
    order = np.argsort(keys)
    return keys[order], logs[order]


def perplexities(docs: DataFrame, trusted: DataFrame, rarest: float = 2e-6) -> DataFrame:
    """docs' columns but the text, and t1, t2 (they stand for the text), n_grams, perplexity, per row of docs."""
    model = Tables(trusted)
    heads, kinds = {}, []
    for k in range(1, ORDER + 1):
        heads["grams", k] = _head(model.grams[k - 1], "p", "n", rarest)
        heads["contexts", k] = _head(model.contexts[k - 1], "gamma", "total", rarest)
        kinds += [(k, model.grams[k - 1]), (ORDER + k, model.contexts[k - 1])]
    shared = docs.sparkSession.sparkContext.broadcast((heads, Packed(bitmap(kinds)), model.base))
    t1, t2 = text_key(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({"t1": t1, "t2": t2, "text": F.coalesce("text", F.lit("")), "row": F.monotonically_increasing_id()})
    beside = [c for c in rows.columns if c not in ("text", "row")]
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in beside)
    scored = settle(rows.select("row", *beside, "text").mapInArrow(
        lambda batches: _scorer(shared, batches), f"row long, {kind}, key long, n long, logs double"), "scored")
    shared.destroy()
    whole = scored.where("logs is not null").drop("key")
    rare = scored.where("logs is null").select("row", "key", "n")
    tail = rare.join(model.probabilities(rare), "key").groupBy("row").agg(F.sum(F.col("n") * F.log("p")).alias("_tail"))
    mean = (F.col("logs") + F.coalesce("_tail", F.lit(0.0))) / F.col("n")
    return whole.join(tail, "row", "left").select(
        *beside, F.col("n").alias("n_grams"),
        F.when((F.col("n") > 0) & F.lit(model.known), F.exp(-mean)).alias("perplexity"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max("quality").alias("q"), F.max("toxic").alias("t")).where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("doc_id")


def _members(batches: Iterator[pa.RecordBatch], bitmaps: list, last: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows whose key is in all bitmaps, or in all but the last of them."""
    for batch in batches:
        keys = batch.column("key").to_numpy().view(np.uint64)
        held = [maybe(shared.value, keys, kind) for kind, shared in enumerate(bitmaps)]
        yield batch.filter(pa.array(np.logical_and.reduce([*held[:-1], held[-1] == last])))


def trusted_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Texts of the documents whose id is in good, one row per document; the ids are compared, few texts move.

    One bitmap of fixed size has all ids of good, a second one the other ids that the first lets through. What is in the first
    alone is trusted for sure; what is in both, a small share, is joined.
    """
    context = docs.sparkSession.sparkContext
    key = F.xxhash64("doc_id").alias("key")
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.where("doc_id is not null and text is not null").select("doc_id", key, "text")
    first = context.broadcast(Packed(bitmap([(0, good.select(key))])))
    let_in = own.select("doc_id", "key").mapInArrow(lambda batches: _members(batches, [first]), f"doc_id {kind}, key long")
    both = [first, context.broadcast(Packed(bitmap([(1, let_in.join(good, "doc_id", "left_anti").select("key"))])))]
    sure, likely = (own.mapInArrow(lambda batches, last=last: _members(batches, both, last), f"doc_id {kind}, key long, text string")
                    for last in (False, True))
    return sure.unionByName(likely.join(good, "doc_id", "left_semi")).select("doc_id", "text")


def quality(docs: DataFrame, labels: DataFrame, share: float = 0.99) -> DataFrame:
    """doc_id, perplexity, threshold, kept for every row of docs (doc_id, text, lang)."""
    good = settle(trusted_ids(labels), "trusted")
    trusted = trusted_texts(docs, good).select("text")
    scored = settle(perplexities(docs.select("doc_id", "lang", "text"), trusted).select("doc_id", "lang", "perplexity"), "scores")
    own = scored.join(good, "doc_id", "left_semi").where("perplexity is not null").select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-")).alias("_lang"), "perplexity")

    overall = quantiles(own.withColumn("_lang", F.lit("")), "_lang", "perplexity", share)
    overall = overall.first()
    return scored.withColumn("_lang", F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-"))).join(
        quantiles(own, "_lang", "perplexity", share).withColumnRenamed("perplexity", "_limit"), "_lang", "left").select(
        "doc_id", "perplexity", F.coalesce("_limit", F.lit(overall.perplexity if overall else None).cast("double")).alias("threshold"),
    ).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
