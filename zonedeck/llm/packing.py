"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Documents are cut into pieces of at most `capacity` tokens (only longer ones are cut;
the first piece may be shorter). The counts by length, at most `capacity` numbers, go
to the driver, where best fit decreasing works on groups of equal bins instead of
documents. The plan says, for each length, which ranks go to which bins and where.
Pieces then get their rank within their length (from ranks within buckets and the
buckets' counts, so that a length that a third of the pieces share stays spread out)
and take their planned slot by a join on the length.

Size bound of what is broadcast: a length adds at most a few groups, so the plan has
a few thousand rows at most whatever the input.

Defined cases: null text is empty; an empty document is its end token alone; equal
rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CAPACITY = 2048
#: Entries that a worker's cache of encoded words may hold before it starts anew.
CACHE = 120_000


class WordCache(dict):
    """Encoded ids of space-delimited words, as little-endian unsigned 32-bit numbers.

    A space between two characters that are not white space always begins a
    pre-token, so a text in which no two white spaces meet is the concatenation of its
    words, each with the space before it.
    """

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def raw(self, text: str) -> bytes:
        return np.asarray(self.encode(text), dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        # A last comma or full stop after a letter is a pre-token of its own.
        if len(word) > 2 and word[-1] in ",." and word[-2].isalpha():
            out = self[word[:-1]] + self[word[-1]]
        else:
            out = self.raw(word)
        self[word] = out
        return out


_TWO_SPACES = re.compile(r"\s\s")
_encoders: dict[str, Callable[[str], bytes]] = {}


def byte_values() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids' bytes; one per worker and file.

    The vocabulary and its order come from the tokenizer's own file; tiktoken applies
    the merges, which takes less than half the time and gives the same ids. Texts are cut at
    the file's added tokens, as the tokenizer does, and those give their own ids.
    """
    if path not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        added = {t["content"]: np.asarray([t["id"]], dtype="<u4").tobytes() for t in whole.get("added_tokens") or ()}
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized") for t in whole.get("added_tokens") or ()):
            raise ValueError("added tokens that take in white space or want whole words aren't supported")
        letters = byte_values()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in letters for c in t) and i < 256 + len(model["merges"])}
        coder = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        cache = WordCache(coder.encode_ordinary)
        get = cache.__getitem__

        def plain(text: str) -> bytes:
            if not text:
                return b""
            if _TWO_SPACES.search(text):
                return cache.raw(text)
            first, *rest = text.split(" ")
            return (get(first) if first else b"") + b"".join([get(" " + w) for w in rest])

        marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def encode(text: str) -> bytes:
            if marks is None or not marks.search(text):
                return plain(text)
            return b"".join(added[part] if k % 2 else plain(part) for k, part in enumerate(marks.split(text)))

        _encoders[path] = encode
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each piece of each document."""
    path = path or default_tokenizer()
    tail = np.asarray([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in common.sliced(batches, "text"):
            rows: list[tuple[int | None, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                at = piece = 0
                while at < n:
                    to = at + (capacity if at else first)
                    rows.append((doc, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, piece = to, piece + 1
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, per_bin, first_bin, offset): of a length's pieces, those of rank lo to hi - 1
    go to bins first_bin, first_bin + 1, ..., per_bin in each, from place offset on.

    Lengths come in descending order. Each goes to the bins with the least room that is
    enough, as many to a bin as fit there; bins in the same state are one group.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # what is left in a bin: groups (first bin, bins)
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = next((r for r in range(length, capacity) if room.get(r)), capacity)
            fit = left // length
            if left == capacity:
                first, n = bins, -(-todo // fit)
                bins += n
            else:
                first, n = room[left].pop()
            full = min(n, todo // fit)
            if full:
                plan.append((length, rank, rank + full * fit, fit, first, capacity - left))
                room.setdefault(left - fit * length, []).append((first, full))
                rank, todo = rank + full * fit, todo - full * fit
                first, n = first + full, n - full
            if n and todo and todo < fit:
                plan.append((length, rank, rank + todo, todo, first, capacity - left))
                room.setdefault(left - todo * length, []).append((first, 1))
                rank, todo = rank + todo, 0
                first, n = first + 1, n - 1
            if n:
                room.setdefault(left, []).append((first, n))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (checkpointed by the caller) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(
        plan_best_fit(counts, capacity) or [(0, 0, 0, 1, 0, 0)], "length long, lo long, hi long, per_bin long, first_bin long, offset0 long"
    )
    buckets = max(16, min(4096, sum(counts.values()) // 50_000))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("at", F.row_number().over(order) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at"))
    p, r = F.broadcast(plan).alias("p"), ranked.alias("r")  # a few thousand rows: see above
    placed = r.join(p, (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + F.pmod(nth, F.col("per_bin")) * F.col("r.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(common.cut(token_pieces(docs, path, capacity)), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
