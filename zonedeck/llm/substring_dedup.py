"""Substring dedup by recompression.

Tokens get global names (hashes of the words). A first round names runs of one token,
further rounds name pairs: a hash bit of a name puts it left or right, and a left name
directly before a right one becomes a new name. Which names pair depends on the names
alone, so equal token windows are parsed alike but for the names at their ends that
something outside might take; those are left out round by round, and what remains is
stable. A window's anchor is, of its stable names of the highest round that has some,
the one whose hash is least. Equal windows have equal anchors at the same place.

0. Of documents with equal texts only the least id's goes on; the others are cut whole.
1. Anchors whose name, with the words next to it, occurs once in the corpus are dropped
   with their windows.
2. The windows at shared anchors get 96 bits hashed from all their words, which verify
   them: 64 from one half of the words' 128-bit hashes and 32 from the other half, so that
   words whose names collide still differ. A window is removed if an equal one starts
   earlier (in a row of smaller id, or in the same row).
3. Words that a removed window covers are cut from their document.

Every shuffle is keyed by name, window hash or document. Before a shuffle, repeats
within a slice of the input are settled there (a later equal window of a slice is
surely removed, and a name that a slice has twice is surely shared), so that a very
common passage sends a row or two a slice and not one an occurrence.

Defined cases: null text has no words; documents shorter than a window lose nothing; a
null id comes before all others; rows that share an id (or have none) are documents of
their own of which none precedes another, so nothing that only they hold goes; rows equal
in id and text lose the same words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
ROUNDS = 4
#: Words that an anchor's name is told apart by; a window is at least that long.
CONTEXT = 6
#: Words whose hashes a worker keeps before it starts anew.
CACHE = 150_000
#: Ids with several texts up to which they are sent to the documents.
MAX_BROADCAST = 100_000
_NULL_ID = -(2**63)
KEY = ["_zd_d", "_zd_j"]


class _Names(dict):
    """Numbers the words a worker has seen; for each the two halves of its 128-bit hash, which are independent names."""

    def __init__(self):
        self.fresh: list[bytes] = []
        self.halves = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(xxhash.xxh3_128_digest(word))
        return n

    def of(self, words: Iterable[bytes], n: int) -> np.ndarray:
        if len(self) >= CACHE:
            self.clear()
            self.halves = self.halves[:0]
        index = np.fromiter(map(self.__getitem__, words), np.int64, n)
        if self.fresh:
            self.halves = np.concatenate([self.halves, np.frombuffer(b"".join(self.fresh), np.uint64).reshape(-1, 2)])
            self.fresh = []
        return self.halves[index]


_names = _Names()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_names(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(salt)))


class Slice:
    """The words of some documents one after another: names, second names, and each document's first place."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.sizes = np.asarray([len(w) for w in self.words], np.int64)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        halves = _names.of(chain.from_iterable(self.words), int(self.first[-1]))
        self.names, self.checks = (np.ascontiguousarray(halves[:, k]) for k in (0, 1))
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)

    def starts(self, window: int) -> np.ndarray:
        """Places at which a window of one document starts."""
        n = len(self.names)
        place = np.arange(max(0, n - window + 1))
        return place[self.doc[place] == self.doc[place + window - 1]] if len(place) else place


def least_in(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Index of the least key of each range [low, high), the first of equal ones; ranges hold 1 to 31."""
    best = [np.arange(len(key), dtype=np.int32)]
    for k in range(4):
        a, shift = best[-1], 1 << k
        b = np.r_[a[shift:], a[len(a) - min(shift, len(a)) :]]
        best.append(np.where(key[b] < key[a], b, a))
    size = high - low
    k = np.asarray([0, *(n.bit_length() - 1 for n in range(1, 32))])[size]
    out = np.empty(len(low), np.int32)
    for n, table in enumerate(best):
        at = np.flatnonzero(k == n)
        a, b = table[low[at]], table[high[at] - (1 << n)]
        out[at] = np.where(key[b] < key[a], b, a)
    return out


def anchors(s: Slice, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, place) of each window: its anchor's name and where that begins.

    The anchor is the stable name of the highest round, among those that leave CONTEXT words
    of the window from their beginning on, whose hash is least.
    """
    start = s.starts(window)
    name, place = s.names[start], start.copy()
    if not len(start):
        return start, name, place
    sym, begin, doc = s.names, np.arange(len(s.names)), s.doc
    left, right = start.copy(), start + window  # stable names of each window: left <= index < right
    last = start + window - CONTEXT  # the name that holds this word is the last that may be an anchor
    holds = np.arange(len(s.names))

    def settle(level: int) -> None:
        high = np.minimum(right, holds[last] + 1)
        some = np.flatnonzero(left < high)
        if len(some):
            at = least_in(mix(sym + np.uint64(7)), left[some], high[some])
            name[some] = mix(sym[at] + np.uint64(level))
            place[some] = begin[at]

    settle(0)
    new = np.r_[True, (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])]
    index = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, len(sym)])
    named = sym[at]
    named = np.where(length > 1, join_names(named, length.astype(np.uint64), 1), named)
    left, right = index[left] + 1, index[right - 1]  # the runs at the ends may go on outside
    sym, begin, doc, holds = named, begin[at], doc[at], index
    settle(1)
    for level in range(2, rounds + 1):
        # Indices past the slice's end are those of windows that have nothing stable left.
        is_right = (mix(sym ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)).astype(bool)
        pair = np.r_[~is_right[:-1] & is_right[1:] & (doc[:-1] == doc[1:]), False]
        keep = np.r_[True, ~pair[:-1]]
        index = np.r_[np.cumsum(keep) - 1, keep.sum()]
        ok = left < right
        left, right = np.where(ok, left, 0), np.where(ok, right, 0)
        left = left + is_right[left]
        right = right - np.where(ok, ~is_right[right - 1], False)
        left, right = index[left], index[right]
        left = np.where(ok, left, right)
        at = np.flatnonzero(keep)
        following = np.minimum(at + 1, len(sym) - 1)
        sym = np.where(pair[at], join_names(sym[at], sym[following], level), sym[at])
        begin, doc, holds = begin[at], doc[at], index[holds]
        settle(level)
    return start, name, place


def anchor_keys(s: Slice, name: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The anchors' names with the CONTEXT words from their beginning on."""
    return join_names(name, window_hash(s.names, CONTEXT, 11)[place], 13)


def window_hash(names: np.ndarray, window: int, salt: int) -> np.ndarray:
    """A hash of the window at each place (the last window - 1 places are of no use)."""
    acc, done, power, width = None, 0, mix(names + np.uint64(salt)), 1
    left = window
    while left:
        if left & 1:
            shifted = np.r_[power[done:], np.zeros(done, np.uint64)] if done else power
            acc = shifted if acc is None else join_names(acc, shifted, salt)
            done += width
        left >>= 1
        if left:
            power = join_names(power, np.r_[power[width:], np.zeros(min(width, len(power)), np.uint64)][: len(power)], salt)
            width *= 2
    return acc


def _spread(n: int, ids: np.ndarray) -> np.ndarray:
    """Keys for rows that are settled already: any task will do."""
    return mix(ids.astype(np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def _keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """docs with _zd_d, the id by which they are ordered, _zd_j, which tells rows of one id apart, and _zd_copy: an equal text has a smaller id.

    (_zd_d, _zd_j) stands for rows that are equal in id and text. _zd_j is a hash of the text
    where an id has several texts and 0 elsewhere, so that it costs the shuffles nothing.
    Whatever reads the texts starts from these rows with all their columns, so that Spark
    deals the texts out by that key once and uses that again.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))
    rows = docs.withColumn("_zd_d", F.coalesce(F.col(ident).cast("long"), F.lit(_NULL_ID)))
    light = common.cut(rows.select("_zd_d", digest.alias("_zd_m")).distinct())
    several = common.cut(light.groupBy("_zd_d").agg(F.count("*").alias("n")).filter("n > 1").select("_zd_d", F.lit(True).alias("_zd_several")))  # a row an id
    if several.count() <= MAX_BROADCAST:  # else the join deals the documents out by id
        several = F.broadcast(several)

    def keyed(df: DataFrame, m: Column) -> DataFrame:
        j = F.when(F.col("_zd_several"), F.xxhash64(m)).otherwise(F.lit(0).cast("long"))
        return df.join(several, "_zd_d", "left").withColumn("_zd_j", j).drop("_zd_several")

    rows, light = keyed(rows, digest), keyed(light, F.col("_zd_m"))
    first = light.groupBy("_zd_m").agg(F.min("_zd_d").alias("_zd_first"), F.max("_zd_d").alias("_zd_last")).filter("_zd_first < _zd_last").select("_zd_m", "_zd_first")
    # Cut: a join of two plain exchanges is one whose large partitions Spark can split.
    copies = common.cut(light.join(common.cut(first), "_zd_m").filter("_zd_d > _zd_first").select("_zd_d", "_zd_j", F.lit(True).alias("_zd_copy")))
    if copies.isEmpty():  # a join that Spark drops only while it runs would keep the readers from sharing one dealing of the texts
        return rows.withColumn("_zd_copy", F.lit(False))
    return rows.join(copies.hint("merge"), KEY, "left").withColumn("_zd_copy", F.coalesce("_zd_copy", F.lit(False)))


def removed_starts(keyed: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(_zd_d, _zd_j, _zd_starts): the places, in words, of the windows that start earlier elsewhere, of all documents but copies."""
    rows = keyed.filter("NOT _zd_copy")
    at_d, at_j, at_text = (rows.columns.index(c) for c in (*KEY, text))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text):
            ids, more = batch.column(at_d).to_numpy(), batch.column(at_j).to_numpy()
            s = Slice(common.text_bytes(batch.column(at_text)))
            start, name, place = anchors(s, window)
            if not len(start):
                continue
            name = anchor_keys(s, name, place)
            # Windows at one anchor are neighbours: one row a run of them.
            new = np.r_[True, (name[1:] != name[:-1]) | (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
            at = np.flatnonzero(new)
            runs, name, begin = np.diff(np.r_[at, len(start)]), name[at], start[at]
            of = s.doc[begin]
            packed = (begin - s.first[of]) * 64 + np.minimum(runs, 63)
            known = _repeated(name, place[at], of)
            key = np.where(known, _spread(len(at), ids[of]), name.view(np.int64))
            probes = np.unique(name[known]).view(np.int64)  # such a name still counts for other slices
            none = np.zeros(len(probes), np.int64)
            columns = [np.r_[key, probes], np.r_[ids[of], none], np.r_[more[of], none], np.r_[packed, none - 1], np.r_[known, np.zeros(len(probes), bool)]]
            yield pa.record_batch([pa.array(c) for c in columns], names=["name", "d", "j", "packed", "known"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, same, columns in _runs(batches, 1):
            name, d, j, packed, known = columns
            again = same | np.r_[same[1:], False]  # the last row of all that came is held back by _runs
            take = (known | again | first) & (packed >= 0)
            yield pa.record_batch([pa.array(d[take]), pa.array(j[take]), pa.array(packed[take])], names=["d", "j", "packed"])

    found = rows.mapInArrow(find, "name long, d long, j long, packed long, known boolean").repartition("name").sortWithinPartitions("name")
    candidates = found.mapInArrow(shared, "d long, j long, packed long").groupBy("d", "j").agg(F.collect_list("packed").alias("packed"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text):
            batch = batch.take(pa.array(np.lexsort((batch.column(at_j).to_numpy(), batch.column(at_d).to_numpy()))))
            ids, more = batch.column(at_d).to_numpy(), batch.column(at_j).to_numpy()
            s = Slice(common.text_bytes(batch.column(at_text)))
            if len(s.names) < window:
                continue
            packed = batch.column(batch.num_columns - 1)
            flat, counts = packed.flatten().to_numpy(), packed.value_lengths().to_numpy(zero_copy_only=False)
            base = np.repeat(s.first[:-1], counts)
            begin, runs = base + flat // 64, flat % 64
            start = np.repeat(begin, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            if not len(start):
                continue
            start = np.unique(start)
            h = window_hash(s.names, window, 11)[start].view(np.int64)
            check = (window_hash(s.checks, window, 12)[start] >> np.uint64(33)).astype(np.int32)
            of = s.doc[start]
            pos = start - s.first[of]
            order = np.lexsort((start, check, h))
            same = np.r_[False, (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])]
            past, _ = _past(same, ids[of[order]], more[of[order]], pos[order])
            earlier = np.zeros(len(start), bool)
            earlier[order] = past
            key = np.where(earlier, _spread(len(start), ids[of]), h)
            columns = [key, check, ids[of], more[of], pos, earlier]
            yield pa.record_batch([pa.array(c) for c in columns], names=["h", "c", "d", "j", "start", "earlier"])

    joined = rows.join(candidates.toDF(*KEY, "_zd_packed").hint("merge"), KEY).select(*rows.columns, "_zd_packed")

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for _, same, (h, c, d, j, start, earlier) in _runs(batches, 2):
            past, before = _past(same, d, j, start, before)
            take = past | earlier
            yield pa.record_batch([pa.array(d[take]), pa.array(j[take]), pa.array(start[take])], names=["d", "j", "start"])

    dealt = joined.mapInArrow(verify, "h long, c int, d long, j long, start long, earlier boolean").repartition("h", "c")
    windows = dealt.sortWithinPartitions("h", "c", "d", "j", "start")
    return windows.mapInArrow(late, "d long, j long, start long").groupBy(F.col("d").alias("_zd_d"), F.col("j").alias("_zd_j")).agg(F.collect_list("start").alias("_zd_starts"))


def _past(same: np.ndarray, d: np.ndarray, j: np.ndarray, start: np.ndarray, before: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Which rows of equal windows, ordered by d, j and start, an earlier one precedes: one of a smaller d, or of the same d and j at a smaller start.

    same: the window equals that of the row before. before: what an earlier call returned second, to go on from.
    """
    low, first, key = before or (0, 0, None)  # of the window and row that may go on: least id, first start, (d, j)
    at = np.arange(len(d))
    head = np.maximum.accumulate(np.where(same, -1, at))
    other = np.r_[not same[0] or key != (d[0], j[0]), ~same[1:] | (d[1:] != d[:-1]) | (j[1:] != j[:-1])]
    own = np.maximum.accumulate(np.where(other, at, -1))
    lowest = np.where(head >= 0, d[np.maximum(head, 0)], low)
    begin = np.where(own >= 0, start[np.maximum(own, 0)], first)
    return (d != lowest) | (start != begin), (lowest[-1], begin[-1], (d[-1], j[-1]))


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows of a partition sorted by the first `keys` columns, as (first, same, columns).

    same: the row has the key of the row before, in this batch or an earlier one; rows
    settled before (last column) never do. first: the row begins a run that goes on in
    the next batch. One row is held back, so that a batch's last row knows what follows.
    """
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = part if held is None else [np.concatenate(x) for x in zip(held, part)]
        settled = columns[-1].astype(bool)
        same = np.r_[False, np.all([x[1:] == x[:-1] for x in columns[:keys]], axis=0)]
        if last is not None and all(x[0] == y for x, y in zip(columns, last)):
            same[0] = True
        held = [x[-1:] for x in columns]
        first = np.zeros(len(same) - 1, bool)
        if len(first):
            first[-1] = same[-1]
            last = [x[-2] for x in columns[:keys]]
            yield first, same[:-1] & ~settled[:-1], [x[:-1] for x in columns]
    if held is not None:
        same = np.asarray([last is not None and all(x[0] == y for x, y in zip(held, last))]) & ~held[-1].astype(bool)
        yield np.zeros(1, bool), same, held


def _repeated(name: np.ndarray, place: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Names that occur at two or more places of the slice."""
    order = np.lexsort((place, name))
    n, p = name[order], place[order]
    change = np.r_[True, n[1:] != n[:-1]]
    other = np.r_[False, p[1:] != p[:-1]] & ~change
    group = np.cumsum(change) - 1
    many = np.bincount(group, weights=other, minlength=group[-1] + 1)[group] > 0
    out = np.zeros(len(name), bool)
    out[order] = many
    return out


def kept_words(words: list[bytes], starts: list[int] | None, window: int = WINDOW) -> list[bytes]:
    """The words that none of the windows covers."""
    if not starts:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    at = at[at + window <= len(words)]
    change[at] += 1
    np.subtract.at(change, at + window, 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, n_removed, and kept_text: the words left, by one space, or the text as it was if none went."""
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    keyed = _keyed(docs.select(*names), ident, text)
    joined = keyed.join(removed_starts(keyed, window, text).hint("merge"), KEY, "left").select(*names, "_zd_copy", "_zd_starts")
    schema = docs.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, text):
            texts = common.text_bytes(batch.column(names.index(text)))
            n, gone, kept = [], [], []
            for t, copy, x in zip(texts, batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                words = t.split()
                left = ([] if len(words) >= window else words) if copy else kept_words(words, x, window)
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append((b" ".join(left) if gone[-1] else t).decode())
            yield pa.record_batch([*batch.columns[:-2], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the text that is left, and its n_chars."""
    done = dedup_substrings(docs, window)
    return done.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.array_join(F.array_remove(F.split("kept_text", r"[\x20\x09-\x0D]+"), ""), " ")
    return done.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(words) - 19)) AS start, words FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, start, array_to_string(list_slice(words, start + 1, start + 20), ' ') AS x FROM s),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY x ORDER BY doc_id, start) AS nth FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT w.doc_id, words, coalesce(gone, []) AS gone,
         CASE WHEN gone IS NULL THEN words
              ELSE [words[i + 1] FOR i IN range(0, len(words)) IF NOT list_contains(gone, i)] END AS kept
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM k
"""
