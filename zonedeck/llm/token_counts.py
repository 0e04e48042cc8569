"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted, not built: a trie over the vocabulary
has failure links, and with each link goes the number of pieces that following it
pops. One step a byte then gives a word's number of pieces (Song et al., "Fast
WordPiece Tokenization", 2021, with counts in place of piece lists).

The vocabulary is a public byte-level one: tokens that begin with a space are
word-initial pieces (without it), the others continue a word. All 256 bytes are
tokens; each may also begin a word, so every word can be cut.

Defined cases: null and empty texts have 0 words and 0 tokens; words are runs of
anything but ASCII white space, of any length; equal rows are counted each; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words that a worker's cache may hold before it starts anew.
CACHE = 500_000


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuing pieces of a file of base64 tokens and ranks."""
    import base64

    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    initial = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1}
    inner = {t for t in tokens if t[:1] != b" "}
    return initial | {t for t in inner if len(t) == 1}, inner


class Automaton(dict):
    """word -> number of pieces; as a dict it caches the words it has seen. 0: the word can't be cut."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        self.root, self.inner_root = 0, 1
        ends, parent = {self.root: False, self.inner_root: False}, {}
        for start, pieces in ((self.root, initial), (self.inner_root, inner)):
            for piece in pieces:
                node = start
                for byte in piece:
                    key = node * 256 + byte
                    if (to := self.step.get(key)) is None:
                        to = self.step[key] = len(ends)
                        ends[to], parent[to] = False, key
                    node = to
                if node != start:
                    ends[node] = True
        # Breadth first: a node's link needs those of its shorter prefixes.
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        depth = {self.root: 0, self.inner_root: 0}
        for node, key in parent.items():  # parents were made before their children
            depth[node] = depth[key // 256] + 1
        for node in sorted(parent, key=depth.__getitem__):
            if ends[node]:
                self.link[node], self.popped[node] = self.inner_root, 1
                continue
            up, byte = divmod(parent[node], 256)
            to, n = self.link[up], self.popped[up]
            while to >= 0 and to * 256 + byte not in self.step:
                n += self.popped[to]
                to = self.link[to]
            if to >= 0:
                self.link[node], self.popped[node] = self.step[to * 256 + byte], n

    def count(self, word: bytes) -> int:
        step, link, popped = self.step, self.link, self.popped
        node = n = 0
        for byte in word:
            while (to := step.get(node * 256 + byte)) is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = to
        while node != self.inner_root and node >= 0:
            n += popped[node]
            node = link[node]
        return n if node >= 0 else 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[word] = self.count(word)
        return n


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(*read_vocabulary(path))
    return _automata[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, path: str | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = automaton(path).__getitem__
        for batch in common.sliced(batches, "text"):
            words = [t.split() for t in common.text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sum(map(get, w)) for w in words], pa.int64())], names=COUNTS.names)

    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, COUNTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
