"""Language identification by one interpolated Kneser-Ney character model per language.

Text becomes lower-case letters with one blank for every run of anything else, after three blanks at the start;
a 4-gram is packed into 64 bits. Spark counts the 4-grams of all training texts per language (each task counts
its own first), continuation counts of the lower orders follow from the distinct n-grams above them, and probabilities and
back-off weights are joined up order by order, as tables sharded by (language, n-gram). Nothing is left out of them.

To score texts, the HEAD most frequent n-grams and contexts of each language and order are
broadcast as sorted hash arrays, with a bitmap of fixed size for all others (see `perplexity`): a task backs off where an
n-gram or context was never seen for sure, and what may be in the tables but isn't broadcast is counted per text and looked up by joins.

A text gets the language of the least cross-entropy per character. Limits are set by texts left out of the counts, one in
LEFT_OUT (by the text's hash, so copies go together): what all but one in a hundred of a language's left-out texts stay below,
less an allowance for short texts, but not less than the language's own cross-entropy in what was counted; the latter alone
where no text was left out. A text is accepted if it is nearer to that than to what random letters have under
the model, drawn from the language's own common letters, so other scripts don't move the limit.

Null or letterless text: language `und`, score 0, not accepted. No training text: every text is `und`.
Ties go to the language that sorts first. Labels are compared as they are; null labels aren't learned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetscore.llm.arrays import column_bytes, distinct, narrow, settle, slices
from fleetscore.llm.perplexity import Packed, bitmap, resolve
from fleetscore.llm.running import quantiles

ORDER = 4
UND = "und"
LEFT_OUT = 16
HEAD = 100_000
_BLANK = 32


def _letters() -> np.ndarray:
    """Code point below 65536 to its lower-case letter, or blank."""
    out = np.full(1 << 16, _BLANK, np.uint64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = narrow(np.array([ord(chr(c).lower()[0])]))[0]
    return out


def _grams(column: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram keys of all rows in order, how many each row has, and how many of its characters are letters."""
    data, offsets = column_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    high = points > 0xFFFF
    codes = letters[np.where(high, 0xFFFF, points) if high.any() else points]
    codes[high] = _BLANK
    for c in np.unique(points[high]):
        if chr(c).isalpha():
            codes[points == c] = narrow(np.array([ord(chr(c).lower()[0])]))[0]
    letter = codes != _BLANK
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1]
    after[ends[:-1][ends[:-1] < len(codes)]] = False
    kept = np.flatnonzero(letter | after)
    counts = np.diff(np.searchsorted(kept, ends))
    row = np.repeat(np.arange(len(counts)), counts)
    line = np.full(len(kept) + (ORDER - 1) * len(counts), _BLANK, np.uint64)
    at = np.arange(len(kept)) + (ORDER - 1) * (row + 1)
    line[at] = codes[kept]
    packed = line.copy()
    for k in range(1, ORDER):
        packed[k:] |= line[:-k] << np.uint64(16 * k)
    keys = packed[at]
    has = np.bincount(row[letter[kept]], minlength=len(counts)) if len(kept) else np.zeros(len(counts), np.int64)
    return keys, counts, has


def _add(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([held[0], keys]), np.concatenate([held[1], n])
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, n).astype(np.int64)


def _counter(letters: np.ndarray, most: int = 1 << 20):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(lang: str) -> pa.RecordBatch:
            keys, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

        for batch in slices(batches, "text"):
            keys, counts, _ = _grams(batch.column("text"), letters)
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                own, place = distinct(keys[np.repeat(np.array([x == lang for x in langs]), counts)])
                if len(own):
                    n = np.bincount(place)
                    held[lang] = _add(held.get(lang, (own[:0], n[:0])), own, n)
                    if len(held[lang][0]) > most:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    return count


def _counted(training: DataFrame) -> list[DataFrame]:
    """Counts (lang, key, n) of the orders 1 to ORDER; below the highest, n is the number of distinct predecessors."""
    out = [settle(training.mapInArrow(_counter(_letters()), "lang string, key long, n long")
                  .groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang-counts")]
    for k in range(ORDER - 1, 0, -1):
        mask = F.lit((1 << (16 * k)) - 1)
        lower = out[-1].groupBy("lang", F.col("key").bitwiseAND(mask).alias("key")).agg(F.count("*").alias("n"))
        out.append(settle(lower, "lang-counts"))
    return out[::-1]


def _tables(counts: list[DataFrame], langs: list[str], base: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per order, grams (lang, key, n, p) and contexts (lang, key, gamma, total)."""
    grams, contexts = [], []
    few = [rows.where("n <= 2").select(F.lit(k).alias("k"), "lang", "n") for k, rows in enumerate(counts, 1)]
    found = {(r.k, r.lang): (r.n1, r.n2) for r in reduce(DataFrame.unionByName, few).groupBy("k", "lang").agg(
        F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
    for k, rows in enumerate(counts, 1):
        seen = {lang: found.get((k, lang), (0, 0)) for lang in langs}
        steps = {lang: min(max(n1 / (n1 + 2 * n2), 0.1), 0.9) if n1 and n2 else 0.5 for lang, (n1, n2) in seen.items()}
        off = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])[F.col("lang")]
        own = rows.withColumns({"off": off, "context": F.shiftrightunsigned("key", 16)})
        held = settle(own.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("gamma")), f"lang-contexts{k}")
        own = own.join(held, ["lang", "context"])
        if grams:
            suffix = F.col("key").bitwiseAND(F.lit((1 << (16 * (k - 1))) - 1))
            lower = grams[-1].select("lang", F.col("key").alias("suffix"), F.col("p").alias("below"))
            own = own.withColumn("suffix", suffix).join(lower, ["lang", "suffix"])
        else:
            own = own.withColumn("below", F.lit(base))
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("below")
        grams.append(settle(own.select("lang", "key", "n", p.alias("p")), f"lang-grams{k}"))
        contexts.append(held.select("lang", F.col("context").alias("key"), "gamma", "total"))
    return grams, contexts


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each kind in a batch as two byte arrays, keys and log values; compressed, so the driver's JVM holds little."""
    for batch in batches:
        kinds, keys, logs = (batch.column(c).to_numpy() for c in ("kind", "key", "log"))
        some = np.unique(kinds)
        packed = [pa.array([zlib.compress(x[kinds == k].tobytes(), 1) for k in some], pa.binary()) for x in (keys, logs)]
        yield pa.RecordBatch.from_arrays([pa.array(some), *packed], ["kind", "keys", "logs"])


def _heads(tables: list[tuple[Column, DataFrame, str, str]], most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per kind, sorted keys and log values of the `most` rows of the greatest weight, from (kinds, table, value, weight).

    One query for all tables; what was found comes to the driver compressed and in four parts.
    """
    rows = [t.select(kind.alias("kind"), "key", F.log(value).alias("log"), F.col(weight).alias("weight")) for kind, t, value, weight in tables]
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("weight"), "key"))
    best = reduce(DataFrame.unionByName, rows).withColumn("_place", place).where(F.col("_place") <= most)
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in best.select("kind", "key", "log").mapInArrow(_packed, "kind int, keys binary, logs binary").repartition(4).toLocalIterator():
        parts.setdefault(r.kind, []).append((np.frombuffer(zlib.decompress(r.keys), np.uint64), np.frombuffer(zlib.decompress(r.logs))))
    out = {}
    for kind, some in parts.items():
        keys, logs = (np.concatenate(x) for x in zip(*some))
        order = np.argsort(keys)
        out[kind] = keys[order], logs[order]
    return out


class Model:
    """One language: its broadcast arrays, its kinds in the bitmap, and what its limit is made of."""

    def __init__(self, number: int, heads: dict, base: float):
        self.kind, self.heads, self.base = 16 * number, heads, base
        self.own = self.spread = self.random = 0.0


class Models(dict):
    """Models by language in order of their names, their common bitmap, and the sharded tables."""

    def __init__(self, grams: list[DataFrame], contexts: list[DataFrame], bits: np.ndarray):
        super().__init__()
        self.grams, self.contexts, self.bits = grams, contexts, bits
        self._shared = None

    def shared(self, spark: SparkSession):
        """What tasks need of the models, broadcast once for all uses until `release`."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(
                ([(m.kind, m.heads, m.base) for m in self.values()], Packed(self.bits), _letters()))
        return self._shared

    def release(self) -> None:
        """Take the broadcast from the executors and the driver; a later use makes it anew."""
        if self._shared is not None:
            self._shared.destroy()
            self._shared = None

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(lang, key, p) for every distinct (lang, key), seen or not."""
        base = next(iter(self.values())).base
        out = wanted.select("lang", "key").distinct().withColumn("p", F.lit(None).cast("double")).withColumn("back", F.lit(1.0))
        for k in range(ORDER, 0, -1):
            own = F.col("key").bitwiseAND(F.lit((1 << (16 * k)) - 1 if k < ORDER else -1))
            seen = self.grams[k - 1].select("lang", F.col("key").alias("_own"), F.col("p").alias("_p"))
            weights = self.contexts[k - 1].select("lang", F.col("key").alias("_context"), F.col("gamma").alias("_g"))
            out = out.withColumn("_own", own).join(seen, ["lang", "_own"], "left").withColumn(
                "_context", F.shiftrightunsigned("_own", 16)).join(weights, ["lang", "_context"], "left").select(
                "lang", "key", F.coalesce("p", F.col("back") * F.col("_p")).alias("p"),
                (F.col("back") * F.coalesce("_g", F.lit(1.0))).alias("back"))
        return out.select("lang", "key", F.coalesce("p", F.col("back") * base).alias("p"))


def _by_language(models: Models, value) -> Column:
    """A value per language, by the column lang."""
    return F.create_map(*[x for lang, m in models.items() for x in (F.lit(lang), F.lit(float(value(m))))])[F.col("lang")]


def train(training: DataFrame, head: int = HEAD) -> Models:
    """Models by language from (text, lang) rows; null texts and null languages are left out."""
    training = training.where("text is not null and lang is not null").select("text", "lang")
    out = F.pmod(F.xxhash64("text"), F.lit(LEFT_OUT)) == 0
    counts = _counted(training.where(~out))
    langs = sorted(r.lang for r in counts[-1].select("lang").distinct().collect())
    if not langs:
        return Models([], [], np.zeros(0, np.uint8))
    base = 1 / (counts[0].select("key").distinct().count() + 1)  # a character that was never seen
    grams, contexts = _tables(counts, langs, base)
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, 16 * k)])[F.col("lang")]
    kinds = [x for k in range(1, ORDER + 1) for x in ((number + k, grams[k - 1]), (number + ORDER + k, contexts[k - 1]))]
    models = Models(grams, contexts, bitmap(kinds))
    values = {"grams": ("p", "n"), "contexts": ("gamma", "total")}
    places = [("grams" if i % 2 == 0 else "contexts", i // 2 + 1) for i in range(len(kinds))]
    heads = _heads([(kind.cast("int"), table, *values[name]) for (kind, table), (name, _) in zip(kinds, places)], head)
    none = np.zeros(0, np.uint64), np.zeros(0)
    for k, lang in enumerate(langs):
        models[lang] = Model(k, {(name, n): heads.get(16 * k + n + ORDER * (name == "contexts"), none) for name, n in places}, base)
    n, log = F.sum("n"), F.log("p")
    for r in grams[-1].groupBy("lang").agg((F.sum(F.col("n") * log) / n).alias("m"), (F.sum(F.col("n") * log * log) / n).alias("s")).collect():
        models[r.lang].own, models[r.lang].spread = -r.m, float(np.sqrt(max(r.s - r.m**2, 0)))
    _set_random(training.sparkSession, models, counts[0])
    left = training.where(out & F.col("lang").isin(langs))
    excess = entropies(left, models).where("n > 0").select("lang", (
        F.element_at("h", _by_language(models, lambda m: m.kind // 16 + 1).cast("int")) - 3 * _by_language(models, lambda m: m.spread) / F.sqrt("n")).alias("excess"))
    for r in quantiles(excess, "lang", "excess", 0.99).collect():
        models[r.lang].own = max(models[r.lang].own, r.excess)
    return models


def _set_random(spark: SparkSession, models: Models, letters: DataFrame) -> None:
    """The cross-entropy of letters drawn at random from those that make up 99 % of a language's."""
    share = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("n"), "key")) - F.col("n")
    common = letters.withColumn("_before", share).withColumn("_all", F.sum("n").over(Window.partitionBy("lang")))
    held: dict[str, list[int]] = {}
    for r in common.where("_before <= 0.99 * _all").select("lang", "key").orderBy("lang", "key").collect():  # characters, not texts
        held.setdefault(r.lang, []).append(r.key)
    rows, sums = [], {}
    for lang, model in models.items():
        noise = np.random.default_rng(0).choice(np.array(held[lang], np.uint64), (20_000, ORDER))
        keys, n = np.unique(sum(noise[:, k] << np.uint64(16 * k) for k in range(ORDER)), return_counts=True)
        log, settled = resolve(keys, model.heads, models.bits, model.base, model.kind)
        sums[lang] = float((n * log)[settled].sum())
        rest = [pa.array([lang] * int((~settled).sum()), pa.string()), pa.array(keys[~settled].view(np.int64)), pa.array(n[~settled])]
        rows.append(pa.Table.from_arrays(rest, ["lang", "key", "n"]))
    unsettled = pa.concat_tables(rows)
    if len(unsettled):
        asked = spark.createDataFrame(unsettled)  # from Arrow: Python rows would need a second set of Python workers on each executor
        for r in asked.join(models.probabilities(asked), ["lang", "key"]).groupBy("lang").agg(F.sum(F.col("n") * F.log("p")).alias("s")).collect():
            sums[r.lang] += r.s
    for lang, model in models.items():
        model.random = -sums[lang] / 20_000


def _scorer(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a text to a row per text (n, log p by language of what is settled here) and a row per text, language and other n-gram."""
    models, bits, letters = shared.value
    for batch in slices(batches, "text", 1 << 19):
        keys, counts, has = _grams(batch.column("text"), letters)
        counts = np.where(has > 0, counts, 0)  # texts without letters have no keys
        unique, place = distinct(keys)
        some = np.flatnonzero(counts)
        first = np.cumsum(counts)[some] - counts[some]
        sums, rare = np.zeros((len(counts), len(models))), []
        for i, (kind, heads, base) in enumerate(models):
            log, settled = resolve(unique, heads, bits, base, kind)
            if len(some):
                sums[some, i] = np.add.reduceat(log[place], first)
            if not settled.all():
                rest = np.flatnonzero(~settled[place])
                row = some[np.searchsorted(first, rest, "right") - 1]
                pairs, n = np.unique(row * len(unique) + place[rest], return_counts=True)
                rare.append((pairs // len(unique), np.full(len(n), i), unique[pairs % len(unique)], n))
        beside = [c for c in batch.schema.names if c not in ("text", "row")]
        names = ["row", *beside, "n", "sums", "i", "key", "times"]
        ends = np.arange(0, sums.size + 1, max(len(models), 1), dtype=np.int32)[: len(counts) + 1]
        lists = pa.ListArray.from_arrays(ends, pa.array(sums.ravel())) if models else pa.array([[]] * len(counts), pa.list_(pa.float64()))
        none = lambda kind, n=len(counts): pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *[batch.column(c) for c in beside], pa.array(counts, pa.int64()), lists, none(pa.int32()), none(pa.int64()), none(pa.int64())], names)
        if rare:
            at, i, key, n = (np.concatenate(x) for x in zip(*rare))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(at)), *[none(batch.column(c).type, len(at)) for c in beside], none(pa.int64(), len(at)),
                 none(pa.list_(pa.float64()), len(at)), pa.array(i, pa.int32()), pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names)


def entropies(docs: DataFrame, models: Models) -> DataFrame:
    """docs' columns but the text, n (characters; 0 without letters) and h: cross-entropy by language, in order of the names."""
    shared = models.shared(docs.sparkSession)
    rows = docs.withColumns({"text": F.coalesce("text", F.lit("")), "row": F.monotonically_increasing_id()})
    beside = [c for c in rows.columns if c not in ("text", "row")]
    kind = ", ".join(["row long", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in beside], "n long, sums array<double>, i int, key long, times long"])
    scored = settle(rows.select("row", *beside, "text").mapInArrow(lambda batches: _scorer(shared, batches), kind), "lang-scores")
    whole = scored.where("key is null").select("row", *beside, "n", "sums")
    if not models:
        return whole.select(*beside, F.lit(0).cast("long").alias("n"), F.col("sums").alias("h"))
    lang = F.element_at(F.array(*map(F.lit, models)), F.col("i") + 1)
    rare = scored.where("key is not null").select("row", "i", lang.alias("lang"), "key", "times")
    tail = rare.join(models.probabilities(rare), ["lang", "key"]).groupBy("row").pivot("i", list(range(len(models)))).agg(F.sum(F.col("times") * F.log("p")))
    more = F.array(*[F.coalesce(F.col(str(k)), F.lit(0.0)) for k in range(len(models))])
    both = whole.join(tail.select("row", more.alias("more")), "row", "left")
    h = F.transform("sums", lambda s, k: -(s + F.coalesce(F.get("more", k), F.lit(0.0))) / F.when(F.col("n") > 0, F.col("n")))
    return both.select(*beside, "n", h.alias("h"))


def decisions(docs: DataFrame, models: Models) -> DataFrame:
    """docs' columns but the text, and lang_pred, score, cross_entropy, accepted."""
    found = entropies(docs, models)
    models.release()
    beside = [c for c in found.columns if c not in ("n", "h")]
    some = F.col("n") > 0
    least = F.array_min("h")
    at = F.array_position("h", least).cast("int")
    names = F.array(*map(F.lit, models)) if models else F.array().cast("array<string>")
    number = lambda value: F.element_at(F.array(*[F.lit(float(value(m))) for m in models.values()]), F.col("_at")) if models else F.lit(0.0)
    found = found.withColumns({"_at": F.when(some, at), "_least": F.when(some, least)})
    limit = number(lambda m: m.own + 0.5 * max(m.random - m.own, 0.0)) + 3 * number(lambda m: m.spread) / F.sqrt("n")
    weight = F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.exp(-(x - F.col("_least")) * F.least("n", F.lit(40))))
    return found.select(
        *beside, F.when(some, F.element_at(names, F.col("_at"))).otherwise(UND).alias("lang_pred"), F.when(some, 1 / weight).otherwise(0.0).alias("score"),
        F.col("_least").alias("cross_entropy"), F.when(some, F.col("_least") <= limit).otherwise(False).alias("accepted"))


def held_out(doc_id: Column) -> Column:
    """Documents kept out of training: crc32 of the id as text leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted for every row; learns from rows not held out."""
    models = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return decisions(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), models)
