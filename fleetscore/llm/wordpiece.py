"""Token counts by greedy longest match, in one pass over a word's characters.

The vocabulary's pieces form a trie with two roots, for the start and for the rest of a word. Every node has the
node where matching goes on when no child fits (its failure link), and the number of pieces that are then complete
(its popped count), both computed once, shorter strings first. So a word's piece count needs no piece and no
second look at a character. A word with a part that no piece covers is one unknown token.

Words are runs of bytes other than blank and 0x09-0x0D, in their own case. Counts of words are remembered
per task up to a fixed number of words. Null and empty texts have no words and no tokens.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscore.llm.arrays import WORD

REMEMBERED = 500_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that start a word, pieces that go on) of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if p[0] != "▁"]


class Automaton:
    START, REST = 0, 1

    def __init__(self, first: Iterable[str], rest: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        self.fail: list[int] = [-1, -1]
        self.popped: list[int] = [0, 0]
        ends: set[int] = set()
        order: list[list[tuple[int, str, int]]] = []
        for root, pieces in ((self.START, first), (self.REST, rest)):
            for piece in pieces:
                node = root
                for depth, c in enumerate(piece):
                    below = self.child[node].get(c)
                    if below is None:
                        below = self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        while len(order) <= depth:
                            order.append([])
                        order[depth].append((node, c, below))
                    node = below
                if piece:
                    ends.add(node)
        for level in order:
            for parent, c, node in level:
                if node in ends:
                    self.fail[node], self.popped[node] = self.REST, 1
                    continue
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.child[at]:
                    n, at = n + self.popped[at], self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.child[at][c], n

    def count(self, word: str) -> int:
        """Number of pieces, 0 if a part of the word is in no piece."""
        child, fail, popped = self.child, self.fail, self.popped
        at, n = self.START, 0
        for c in word:
            below = child[at].get(c)
            while below is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                below = child[at].get(c)
            at = below
        while at > self.REST:
            n += popped[at]
            at = fail[at]
        return n if at == self.REST else 0


class _Remembered(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.count(word)
        if len(word) <= 100:
            self[word] = n
        return n


def token_counter(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A function of a text column: struct<n_words, n_tokens, n_unknown>. The vocabulary file bounds the broadcast."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(read_vocabulary(vocabulary)))

    @F.arrow_udf("struct<n_words:long, n_tokens:long, n_unknown:long>")
    def count(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Remembered(Automaton(*pickle.loads(shared.value)))
        words = re.compile(WORD).findall
        for column in columns:
            rows = []
            for text in column:
                counts = [known[w] for w in words(text.as_py() or "")]
                unknown = counts.count(0)
                rows.append((len(counts), sum(counts) + unknown, unknown))
            yield pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n_words", "n_tokens", "n_unknown"])

    return count.asNondeterministic()


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of docs."""
    count = token_counter(docs.sparkSession, vocabulary)
    return docs.select("doc_id", count(F.col("text")).alias("c")).select("doc_id", "c.*")
