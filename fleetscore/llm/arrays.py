"""Words of Arrow text columns as hash arrays, and small helpers that several operators share.

A word is a maximal run of bytes other than blank and 0x09-0x0D; A-Z are lower-cased. All functions work
on the bytes of a column in pieces of about a megabyte, so memory doesn't follow the batch or a long text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscore.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
# Characters of scripts that set no blanks between words (Thai to Tibetan, Myanmar, Khmer, Kana, Han, full-width forms).
UNSPACED = r"\x{0E00}-\x{107F}\x{1780}-\x{17FF}\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFFF}\x{20000}-\x{3FFFF}"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, and its size is known."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a settled table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text, as two longs."""
    return [F.xxhash64(text), F.xxhash64(F.lit(20011), text)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64 bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def narrow(points: np.ndarray) -> np.ndarray:
    """Code points as 16-bit codes: those above 65535 share the 8,448 codes from 0xD800, which no letter or blank has."""
    points = points.astype(np.uint64)
    return np.where(points > 0xFFFF, np.uint64(0xD800) + points % np.uint64(8447), points)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place of each key in them; hashed first, so only the distinct ones are sorted."""
    coded = pa.array(keys).dictionary_encode()
    unique = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(unique)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return unique[order], place[coded.indices.to_numpy(zero_copy_only=False)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, inverse))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows in them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]: at[-1]], at - at[0]


def _pieces(data: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges that end behind white space; a longer word stays whole."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + size, n)
        while end < n:
            window = data[start:end]
            blanks = np.flatnonzero((window == 32) | ((window >= 9) & (window <= 13)))
            if len(blanks):
                end = start + int(blanks[-1]) + 1
                break
            end = min(end + size, n)
        yield start, end
        start = end


def _unspaced(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the UNSPACED characters of UTF-8 bytes."""
    lead = np.flatnonzero(piece >= 0xE0)
    lead = lead[lead + 2 < len(piece)]
    a, b = piece[lead].astype(np.int64), piece[lead + 1]
    code = a << 8 | b  # the first two bytes tell the blocks of 64 (three bytes) or 4096 (four bytes) characters
    three = np.zeros(len(lead), bool)
    for low, high in ((0xE0B8, 0xE181), (0xE19E, 0xE19F), (0xE380, 0xE383), (0xE390, 0xE9BF), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBF)):
        three |= (code >= low) & (code <= high)
    four = (code >= 0xF0A0) & (code <= 0xF0BF)
    lead, size = lead[three | four], np.where(four, 4, 3)[three | four]
    return lead, np.minimum(lead + size, len(piece))


def word_hasher(units: bool = False) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """A function of bytes and offsets to (hashes, first bytes, ends, counts): the words of all rows in order,
    and how many each row has. A word's hash is a polynomial of its bytes modulo 2**64, mixed. With `units`, each
    character of a script without blanks is a word."""
    tables = _powers(_PIECE)

    def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        hashes, starts, ends = [], [], []
        inner = offsets[1:-1]
        for a, b in _pieces(data, _PIECE):
            piece = data[a:b]
            piece = piece + (((piece >= 65) & (piece <= 90)).astype(np.uint8) << 5)
            word = ~((piece == 32) | ((piece >= 9) & (piece <= 13)))
            cut = np.zeros(b - a + 1, bool)
            cut[0] = cut[-1] = True
            cut[inner[np.searchsorted(inner, a): np.searchsorted(inner, b, "right")] - a] = True
            if units:
                for edges in _unspaced(piece):
                    cut[edges] = True
            first = word & cut[:-1]
            first[1:] |= word[1:] & ~word[:-1]
            last = word & cut[1:]
            last[:-1] |= word[:-1] & ~word[1:]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            power, inverse = tables if len(piece) <= _PIECE else _powers(len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * inverse[s]))
            starts.append(s + a)
            ends.append(e + a)
        h, s, e = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (starts, np.int64), (ends, np.int64)))
        return h, s, e, np.diff(np.searchsorted(s, offsets))

    return words


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of text (a longer text comes alone)."""
    for batch in batches:
        size = np.cumsum(np.diff(column_bytes(batch.column(text))[1]))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def shingles(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of the n-word runs of one text; a shorter text is one run as a whole."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, seed + n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k: len(h) - n + 1 + k]
    return mix(out)
