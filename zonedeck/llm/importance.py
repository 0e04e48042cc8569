"""Quality by importance resampling.

Two generative models of hashed n-grams (words and word pairs, BUCKETS buckets) are
counted: the target over texts labelled good (at most MAX_GOOD of them, those with the
least hash of the id), the raw one over all texts. A document's log weight is the log of
the ratio of the probabilities that the two models give it: the sum of its n-grams' log
ratios. `length` gives instead the mean times that number, as if every document had so
many n-grams, which doesn't favour long ones. Gumbel noise hashed from id and text is
added and the k highest keys are the sample, k the share of good labels times the
number of documents unless a share is given.

The k-th key comes from histograms that narrow down on it, then on ids and rows among
equal keys; rows are never gathered.

Defined cases: null and empty texts, which have no n-grams, have log weight EMPTY;
equal keys go to the smaller id, null first; of rows equal in id and text any may be
taken, but exactly k rows are; a document labelled twice counts once if either label is
good; without any good label all log weights are 0; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS = 10_000
EMPTY = -1e6
CACHE = 500_000
#: The bound of the labelled sample that the target is counted over.
MAX_GOOD = 20_000
_BINS, _FEW = 4096, 20_000
_NULL_ID = -(2**63)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the texts, and how many each text has (2n - 1 for n words)."""
    get = _hashes.__getitem__
    split = [t.lower().split() for t in texts]
    n = np.asarray([len(w) for w in split], np.int64)
    h = np.fromiter((get(w) for ws in split for w in ws), np.uint64, int(n.sum()))
    doc = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both = (h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)
    # A text's words, then its pairs: order by text so that sums run over stretches.
    order = np.argsort(np.r_[doc, doc[pair]], kind="stable")
    return (np.r_[h >> np.uint64(20), both] % np.uint64(BUCKETS)).astype(np.int64)[order], np.where(n > 0, 2 * n - 1, 0)


def count_ngrams(docs: DataFrame) -> np.ndarray:
    """Counts by bucket over all texts: each task sums its own, BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in common.sliced(batches, "text"):
            total += np.bincount(ngram_buckets(common.text_bytes(batch.column(0)))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability by bucket, each with one count added."""
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weight(texts: list[bytes], ratios: np.ndarray, length: float | None = None) -> np.ndarray:
    """Log of the ratio of the models' probabilities of each text; length: as if each had so many n-grams."""
    bucket, n = ngram_buckets(texts)
    sums = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        sums[some] = np.add.reduceat(ratios[bucket], (np.cumsum(n) - n)[some])
    return np.where(n > 0, sums if length is None else length * sums / np.maximum(n, 1), EMPTY)


def gumbel(ident: Column, text_hash: Column, seed: str = "importance") -> Column:
    from .mixing import uniform

    return -F.log(-F.log(uniform(F.concat_ws(":", ident.cast("string"), text_hash.cast("string")), seed)))


def kth(rows: DataFrame, column: str, k: int, descending: bool = False) -> tuple[float, int, int]:
    """(value, before, equal): the k-th value of a numeric column without nulls, the rows before it, and those equal to it."""
    x, whole = F.col(column), not isinstance(rows.schema[column].dataType, T.DoubleType)
    low, high = rows.agg(F.min(x), F.max(x)).first()
    before, inside = 0, rows
    while low != high:
        width = (high - low) // _BINS + 1 if whole else (high - low) / _BINS
        if whole and width == 1 or not whole and low + width == low:
            at = x  # few values are left
        elif whole:
            at = F.expr(f"cast(({column} - cast({low} as decimal(20,0))) div {width} as int)")
        else:
            at = F.least(F.floor((x - low) / width), F.lit(_BINS - 1)).cast("int")
        # Some thousand rows at most: a bin or a value each.
        bins = inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(x).alias("a"), F.max(x).alias("b")).collect()
        for r in sorted(bins, key=lambda r: r["at"], reverse=descending):
            if before + r["n"] >= k:
                break
            before += r["n"]
        low, high, n = r["a"], r["b"], r["n"]
        inside = rows.filter(x.between(F.lit(low), F.lit(high)))
        if low == high:
            return low, before, n
        if n <= _FEW:
            values = sorted((v for (v,) in inside.select(x).collect()), reverse=descending)
            value = values[k - before - 1]
            return value, before + values.index(value), values.count(value)
    return low, before, inside.count()


def top_k(keyed: DataFrame, k: int) -> DataFrame:
    """keyed (doc_id, key, ...) with keep: whether the row is among the k highest keys, of equal ones those of smaller id, null first; exactly k are."""
    names = keyed.columns
    rows = common.cut(keyed.withColumn("_zd_id", F.coalesce("doc_id", F.lit(_NULL_ID))).withColumn("_zd_row", F.monotonically_increasing_id()))
    total = rows.count()
    if k <= 0 or k >= total:
        return rows.withColumn("keep", F.lit(k > 0)).select(*names, "keep")
    taken, tied, left, some = F.lit(False), F.lit(True), k, rows
    for column, descending in (("key", True), ("_zd_id", False), ("_zd_row", False)):
        value, before, equal = kth(some, column, left, descending)
        x = F.col(column)
        taken = taken | (tied & ((x > value) if descending else (x < value)))
        tied, left = tied & (x == value), left - before
        if left == equal:
            break
        some = some.filter(x == value)
    return rows.withColumn("keep", taken | tied).select(*names, "keep")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, length: float | None = None) -> DataFrame:
    """(doc_id, log_weight, key, keep) of every row of docs (doc_id, text)."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Bounded, so that the texts needn't be dealt out to meet the labels.
    good = F.broadcast(known.filter("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_GOOD))
    ratios = log_ratios(count_ngrams(docs.join(good, "doc_id", "left_semi")), count_ngrams(docs))
    if share is None:
        share = known.agg(F.avg("quality")).first()[0] or 1.0
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "text"):
            weights = pa.array(log_weight(common.text_bytes(batch.column(2)), shared.value, length))
            yield pa.record_batch([batch.column(0), batch.column(1), weights], names=["doc_id", "t", "log_weight"])

    text = F.col("text").cast("string")
    weights = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(run, "doc_id long, t long, log_weight double")
    keyed = common.cut(weights.select("doc_id", "log_weight", (F.col("log_weight") + gumbel(F.col("doc_id"), F.col("t"))).alias("key")))
    return top_k(keyed, math.ceil(share * keyed.count()))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
