"""Approximate nearest neighbours: adaptive dimension scan within probed lists.

Lists come from k-means on a bounded sample (those with the least hash of the id); there
are as many as the root of the number of vectors, MAX_LISTS at most, and the sample
grows with them, up to MAX_SAMPLE vectors. Every vector is assigned to a list. Vectors are
rotated by a random orthogonal matrix, so that a few of the rotated dimensions estimate a
distance. Within a list, candidates come in parts, each some times as large as the one
before; a part lies in blocks of columns, and after each block a hypothesis test abandons
those whose partial distance shows them to be farther than the query's k-th nearest of the
parts before, so the limit tightens as the scan goes on. What is left gets its exact
distance on the original vectors.

How many lists are probed is set on the sample: enough for the share `recall` of the
true neighbours there (which lie farther apart than in the whole table).

A list's candidates are dealt into chunks of about CHUNK and its queries into blocks of
about QUERIES, which meet one task at a time; a chunk returns k rows a query. Beyond
MAX_LISTS squared vectors the lists themselves grow, and the work a query with them.

Defined cases: vectors null, zero, of another length than most of the sample, or with
null or non-finite components take no part; rows of one id count as one vector each
but are never each other's neighbours; equal distances go to the smaller id; with at
most k candidates all are returned; without any vector the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The sample's size: so many vectors, or PER_LIST a list, MAX_SAMPLE at most.
SAMPLE, PER_LIST, MAX_SAMPLE = 20_000, 16, 131_072
MAX_LISTS = 8192
#: Candidates of the first part of a scan, and by how much the next ones grow.
FIRST, GROWTH = 64, 4
CHUNK, QUERIES = 4096, 1024
BLOCK = 16
#: Of the hypothesis test; the larger, the fewer true neighbours are abandoned.
EPSILON = 3.0
RECALL = 0.98


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def nearest_lists(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
    if n >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    if n == 1:
        return d.argmin(axis=1)[:, None]
    some = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        of = np.concatenate([nearest_lists(x[i : i + 4096], centres, 1)[:, 0] for i in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """Lists to probe so that the share `recall` of the k nearest within x is in them."""
    q = x[:: max(1, len(x) // queries)][:queries]
    d = (x**2).sum(axis=1) - 2 * (q @ x.T)
    near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]
    own = nearest_lists(x, centres, 1)[:, 0]
    order = nearest_lists(q, centres, len(centres))
    place = np.argsort(order, axis=1)
    ranks = np.take_along_axis(place, own[near], 1).ravel()
    return int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else len(centres)


def scan(q: np.ndarray, qr: np.ndarray, q_ids: np.ndarray, x: np.ndarray, xr: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, exact distance): for each query at least its k nearest of the chunk that no test abandoned.

    q, x original; qr, xr rotated. The first part is measured whole and sets a limit; later
    parts go through the rotated dimensions a block of columns at a time, and what they
    bring tightens it.
    """
    dim = x.shape[1]
    ends = [min(len(x), max(4 * k, FIRST))]
    while ends[-1] < len(x):
        ends.append(min(len(x), ends[-1] * (1 + GROWTH)))
    parts = [(a, b, [np.ascontiguousarray(xr[a:b, d : d + BLOCK].T) for d in range(0, dim, BLOCK)]) for a, b in zip(ends, ends[1:])]
    out_q, out_x, out_d = [], [], []
    for i in range(len(q)):
        rows = np.arange(ends[0])
        dist = np.sqrt(((x[: ends[0]] - q[i]) ** 2).sum(axis=1))
        dist[x_ids[rows] == q_ids[i]] = np.inf
        for a, b, blocks in parts:
            limit = np.partition(dist, k - 1)[k - 1] if len(dist) >= k else np.inf
            alive = surviving(blocks, qr[i], limit, dim) + a
            if not len(alive):
                continue
            more = np.sqrt(((x[alive] - q[i]) ** 2).sum(axis=1))
            more[x_ids[alive] == q_ids[i]] = np.inf
            rows, dist = np.r_[rows, alive], np.r_[dist, more]
            best = np.lexsort((x_ids[rows], dist))[:k]
            rows, dist = rows[best], dist[best]
        best = np.lexsort((x_ids[rows], dist))[:k]
        best = best[np.isfinite(dist[best])]
        out_q.append(np.full(len(best), i))
        out_x.append(rows[best])
        out_d.append(dist[best])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def surviving(blocks: list[np.ndarray], query: np.ndarray, limit: float, dim: int) -> np.ndarray:
    """Candidates that no test abandons; blocks: their rotated dimensions, BLOCK at a time."""
    alive = np.arange(blocks[0].shape[1])
    if not np.isfinite(limit):
        return alive
    partial = np.zeros(len(alive))
    for b, block in enumerate(blocks):
        part = block if len(alive) == block.shape[1] else block[:, alive]
        partial = partial + ((part - query[b * BLOCK : b * BLOCK + len(block), None]) ** 2).sum(axis=0)
        done = min(dim, (b + 1) * BLOCK)
        # As if the rest of the dimensions were like these; the margin shrinks with those seen.
        slack = 1 + EPSILON / np.sqrt(done) if done < dim else 1 + 1e-9
        stay = partial * (dim / done) <= (limit * slack) ** 2
        alive, partial = alive[stay], partial[stay]
        if not len(alive):
            break
    return alive


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of vectors to each row of queries, by Euclidean distance."""
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    base, asked = pick(vectors), pick(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MAX_LISTS, int(base.count() ** 0.5)))
    size = min(MAX_SAMPLE, max(SAMPLE, PER_LIST * lists))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(size).select("x").toArrow()
    if not sample.num_rows:
        return empty
    column = sample.column("x").combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    dim = int(np.bincount(lengths).argmax())
    x = matrix(column.filter(pa.array(lengths == dim)))
    base, asked = base.filter(F.size("x") == dim), asked.filter(F.size("x") == dim)
    centres = kmeans(x, lists)
    probes = probes_needed(x, centres, k, recall)
    shared = spark.sparkContext.broadcast((centres, rotation(dim)))  # MAX_LISTS + dim vectors

    def assign(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = nearest_lists(matrix(batch.column(1)), shared.value[0], n)
                row = np.repeat(np.arange(batch.num_rows), lists.shape[1])
                yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(lists.ravel().astype(np.int32))], names=["id", "x", "list"])

        return run

    schema = "id long, x array<double>, list int"
    held = base.mapInArrow(assign(1), schema)
    probing = asked.mapInArrow(assign(probes), schema)
    # Chunks and query blocks of each list: MAX_LISTS rows at most.
    dealt = (
        held.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        .join(probing.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "list")
    )
    dealt = F.broadcast(common.cut(dealt))
    held = held.join(dealt, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    probing = probing.join(dealt, "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    key = ["list", "chunk", "block"]

    def search(candidates: pa.Table, some: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not candidates.num_rows or not some.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        turn = shared.value[1]
        xs, qs = matrix(candidates.column("x").combine_chunks()), matrix(some.column("x").combine_chunks())
        x_ids, q_ids = candidates.column("id").to_numpy(), some.column("id").to_numpy()
        qi, xi, d = scan(qs, qs @ turn, q_ids, xs, xs @ turn, x_ids, k)
        return pa.table([pa.array(q_ids[qi]), pa.array(x_ids[xi]), pa.array(d)], names=names)

    found = held.select(*key, "id", "x").groupBy(*key).cogroup(probing.select(*key, "id", "x").groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.pmod("vec_id", F.lit(100)) == 0))
