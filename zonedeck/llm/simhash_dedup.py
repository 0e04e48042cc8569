"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has the majority bits of the XXH64 of its word shingles.
Fingerprints within `radius` differing bits are linked, and linked documents form
components.

Equal fingerprints are one node. Fingerprints are cut into radius + 2 blocks of bits;
those within the radius share two blocks exactly (with a radius of 2, 32 bits), so they
meet in the bucket of that pair of blocks, with few others. A bucket is
stored as vertical bit planes, 64 fingerprints a machine word; all distances to a
query fingerprint grow plane by plane in bitwise carry-save counters, and a word whose
64 counters have all passed the radius is abandoned. A bucket of over CHUNK
fingerprints is cut into chunks that meet pairwise in tasks of their own; a task keeps
only the links that join its pieces, so its output is at most its input.

Defined cases: texts without words have fingerprint zero, linked like any other;
shorter texts than a shingle hash their whole word sequence; null text is empty;
equal rows share a component; other columns are kept out of the way.

Near copies (without_near_copies, the pipeline's stage) are texts whose sets of 5-word
shingles have a Jaccard similarity of NEAR or more. Prints of such texts differ by more
bits than blocks of bits can serve, so their buckets are bands of minimum hashes; in a
bucket the same bit-sliced comparison picks what is within NEAR_RADIUS, and every link
is verified on the sets. Pairs with a bucket's least text and with the one before come
first; then all pairs that components still separate. Equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

CHUNK = 1024
RADIUS = 2
SEED = 42
#: Near copies: words a shingle, least Jaccard similarity, bits that prints may differ by, bands of minimum hashes and hashes a band.
NEAR_SIZE, NEAR, NEAR_RADIUS, BANDS, BAND_ROWS = 5, 0.8, 20, 16, 4


def shingle_hashes(words: list[bytes], size: int = 3) -> np.ndarray:
    """XXH64 of each run of `size` words, of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.asarray([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(x), SEED) for x in zip(*(words[i:] for i in range(size)))), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, size: int = 3) -> int:
    return majority(shingle_hashes(text.lower().split(), size))  # bytes.lower() changes A-Z only


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, t, fp) of each row: t is a hash of the text, fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "text"):
            fps = np.asarray([fingerprint(t, size) for t in common.text_bytes(batch.column(2))], np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=PRINTS.names)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(run, PRINTS)


def near_pairs(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of the same group within the radius; where a group has two sides, of different sides only.

    fps: unsigned, ordered by group. Each group fills words of 64 lanes of its own.
    """
    n = len(fps)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = (sizes + 63) // 64
    word0 = np.r_[0, np.cumsum(words)]
    of = np.repeat(np.arange(len(starts)), sizes)
    lane = np.arange(n) - starts[of]
    slot = word0[of] * 64 + lane
    padded = np.zeros(word0[-1] * 64, np.uint64)
    padded[slot] = fps
    used = np.zeros(word0[-1] * 64, bool)
    used[slot] = True
    at = np.full(word0[-1] * 64, -1, np.int64)
    at[slot] = np.arange(n)
    lanes = np.packbits(used, bitorder="little").view("<u8")
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")  # 64 x words
    flip = np.where(np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool), ~np.uint64(0), np.uint64(0))  # 64 x n
    levels = int(radius).bit_length()
    found_i, found_j = [], []
    # Every fingerprint is a query against the words of its group, a few million (query, word) at once.
    per = words[of]
    ends = np.cumsum(per)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), "right")))
        q = np.repeat(np.arange(a, b), per[a:b])
        w = np.arange(len(q)) - np.repeat(ends[a:b] - per[a:b] - (ends[a - 1] if a else 0), per[a:b]) + word0[of[q]]
        counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
        over = ~lanes[w]  # lanes without a fingerprint are past the radius from the start
        for plane in range(64):
            carry = planes[plane][w] ^ flip[plane][q]
            for k in range(levels):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if plane % 8 == 7:
                past = over | _above(counters, radius)
                alive = past != ~np.uint64(0)
                if alive.mean() < 0.6:  # abandon the words whose counters have all passed it
                    q, w, over, counters = q[alive], w[alive], over[alive], [c[alive] for c in counters]
                    if not len(q):
                        break
        if len(q):
            near = ~(over | _above(counters, radius))
            hit = np.flatnonzero(near)
            if len(hit):
                on = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, c = np.nonzero(on)
                i, j = q[hit][r], at[w[hit][r] * 64 + c]
                keep = (i < j) & ((side[i] != side[j]) | (side[i] < 0))
                found_i.append(i[keep])
                found_j.append(j[keep])
        a = b
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter is over the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least reachable index of each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        was = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == was).all():
            return label


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns in parts that end with a group, a group being equal rows of the first columns."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [c.to_numpy(zero_copy_only=False).astype(np.int64) if pa.types.is_integer(c.type) else np.asarray(common.text_bytes(c), object) for c in batch.columns]
        if rest is not None:
            part = [np.concatenate(x) for x in zip(rest, part)]
        ids = part[:keys]
        new = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in ids], axis=0)])
        yield [x[: new[-1]] for x in part]
        rest = [x[new[-1] :] for x in part]  # the last group may go on in the next batch
    if rest is not None:
        yield rest


def link_classes(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (u, v) that connect what is within the radius, from distinct (fp, node)."""
    blocks = radius + 2
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    size = [b - a for a, b in zip(edges, edges[1:])]
    pairs = [F.shiftleft(part[i], size[j]).bitwiseOR(part[j]) for i, j in combinations(range(blocks), 2)]
    key = F.array(*[F.struct(F.lit(k).alias("block"), bits.alias("bits")) for k, bits in enumerate(pairs)])
    rows = prints.select("fp", "node", F.explode(key).alias("k")).select("fp", "node", F.col("k.block").alias("block"), F.col("k.bits").alias("bits"))
    shared = rows.groupBy("block", "bits").agg(F.count("*").alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / chunk))
    rows = rows.join(shared, ["block", "bits"]).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks"))
    # A chunk meets itself and every other chunk of its bucket; in a pair of chunks only links across count.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("block", "bits", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "fp", "node")
    dealt = rows.repartition("block", "bits", "ci", "cj").sortWithinPartitions("block", "bits", "ci", "cj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(links, whole_groups(batches, 4))

    def links(part: list[np.ndarray]) -> pa.RecordBatch:
        b, k, ci, cj, side, fp, node = part
        if len(b):
            change = np.r_[True, (b[1:] != b[:-1]) | (k[1:] != k[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])]
            i, j = near_pairs(fp.view(np.uint64), np.cumsum(change), side, radius)
            label = forest(i, j, len(fp))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            u, v = node[moved], node[label[moved]]
        else:
            u = v = np.zeros(0, np.int64)
        return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicate_classes(docs: DataFrame, radius: int = RADIUS, size: int = 3, prints: DataFrame | None = None) -> DataFrame:
    """(doc_id, t, fp, component_id) of every row of docs (doc_id, text)."""
    prints = common.cut(fingerprints(docs, size)) if prints is None else prints
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    classes = components(link_classes(nodes.filter("node IS NOT NULL"), radius))
    named = nodes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "t", "fp", "component_id")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = 3) -> DataFrame:
    """docs with one document of each component, that of the least id; rows without an id stay, as do other texts of an id that goes."""
    return _without(docs, near_duplicate_classes(docs.select("doc_id", "text"), radius, size))


def _without(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs without the rows, known by id and text, whose component (doc_id, t, component_id) has a smaller id."""
    gone = classes.filter("doc_id != component_id").select(F.col("doc_id").alias("_zd_d"), F.col("t").alias("_zd_t")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("_zd_d")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_zd_t"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, ordered."""
    return np.unique(shingle_hashes(text.lower().split(), NEAR_SIZE))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * BAND_ROWS
    return r.integers(0, 1 << 64, n, np.uint64), r.integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash for each band of minimum hashes, of a set that isn't empty."""
    flips, factors = _MIXERS
    least = np.full(len(flips), ~np.uint64(0))
    for a in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[a : a + 4096, None] ^ flips) * factors).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.asarray([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64)


_MIXERS = _mixers()
SKETCHES = "doc_id long, t long, node long, fp long, bands array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, t, node, fp, bands) of each row: t is a hash of the text, node one of its shingle set; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "text"):
            sets = [shingle_set(t) for t in common.text_bytes(batch.column(2))]
            node = np.asarray([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
            fps = np.asarray([majority(s) for s in sets], np.uint64)
            keys = [bands(s).view(np.int64) if len(s) else [] for s in sets]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t", "node", "fp", "bands"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(run, SKETCHES)


def dealt_buckets(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(bits, ci, cj, side, fp, node, component) of the bands' buckets that hold several components, in chunks that meet pairwise."""
    rows = nodes.select(F.explode("bands").alias("bits"), "fp", "node", "component")
    shared = rows.groupBy("bits").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = shared.filter("low < high").select("bits", F.ceil(F.col("n") / chunk).alias("chunks"))
    rows = rows.join(shared, "bits").withColumn("own", F.pmod(F.xxhash64("node"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    return rows.select("bits", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), side, "fp", "node", "component")


def pairs_apart(part: list[np.ndarray], radius: int = NEAR_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) within the radius, of the same bucket and of different components."""
    b, ci, cj, side, fp, _, component = part[:7]
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.r_[True, (b[1:] != b[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])]
    i, j = near_pairs(fp.view(np.uint64), np.cumsum(change), side, radius)
    apart = component[i] != component[j]
    return i[apart], j[apart]


def first_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes (node, fp, bands, component): each with the least one and the one before it in a bucket, within the radius."""

    def pairs(part: list[np.ndarray]) -> pa.RecordBatch:
        (i, j), n, node = pairs_apart(part), len(part[0]), part[5]
        low, last = np.full(n, n), np.full(n, -1)
        np.minimum.at(low, j, i)
        np.maximum.at(last, j, i)
        at = np.flatnonzero(last >= 0)
        i, j = np.r_[low[at], last[at]], np.r_[at, at]
        return pa.record_batch([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

    dealt = dealt_buckets(nodes).repartition("bits", "ci", "cj").sortWithinPartitions("bits", "ci", "cj", "node")
    return dealt.mapInArrow(lambda batches: map(pairs, whole_groups(batches, 3)), "a long, b long").distinct()


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same >= NEAR * (len(x) + len(y) - same)


def remaining_links(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (u, v) of all pairs within the radius that components still separate, from dealt buckets and texts (node, text).

    A task keeps the links that join its pieces and skips pairs they have joined already.
    """

    def links(part: list[np.ndarray]) -> pa.RecordBatch:
        (i, j), node, component, text = pairs_apart(part), part[5], part[6], part[7]
        sets: dict[int, np.ndarray] = {}
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        u, v = [], []
        for p, q in zip(i.tolist(), j.tolist()):
            a, b = top(int(component[p])), top(int(component[q]))
            if a == b:
                continue
            for k in (p, q):
                if node[k] not in sets:
                    sets[node[k]] = shingle_set(text[k])
            if alike(sets[node[p]], sets[node[q]]):
                up[max(a, b)] = min(a, b)
                u.append(node[p])
                v.append(node[q])
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    dealt = buckets.join(texts, "node").select("bits", "ci", "cj", "side", "fp", "node", "component", "text")
    dealt = dealt.repartition("bits", "ci", "cj").sortWithinPartitions("bits", "ci", "cj", "node")
    return dealt.mapInArrow(lambda batches: map(links, whole_groups(batches, 3)), "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v): the pairs (a, b) whose texts (node, text) have the similarity."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [alike(shingle_set(x), shingle_set(y)) for x, y in zip(common.text_bytes(batch.column(2)), common.text_bytes(batch.column(3)))]
            kept = batch.select([0, 1]).filter(pa.array(both, pa.bool_()))
            yield pa.record_batch(kept.columns, names=["u", "v"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long")


def near_copy_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, t, component_id) of the rows of docs (doc_id, text) that have an id: near copies share a component, its least id."""
    rows = common.cut(sketches(docs).filter("doc_id IS NOT NULL"))
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    alone = nodes.select("node", "fp", "bands", F.col("node").alias("component"))
    first = common.cut(first_pairs(alone))

    def texts(wanted: DataFrame) -> DataFrame:
        wanted = nodes.join(wanted.distinct(), "node").select("node", "row.doc_id", "row.t")
        text = F.col("text").cast("string")
        held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
        return held.join(wanted, ["doc_id", "t"]).groupBy("node").agg(F.first("text").alias("text"))

    links = common.cut(verified(first, texts(first.select(F.explode(F.array("a", "b")).alias("node")))))
    classes = components(links)
    named = alone.drop("component").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = common.cut(dealt_buckets(named))
    more = common.cut(remaining_links(rest, texts(rest.select("node"))))
    final = components(links.union(more))
    found = rows.select("doc_id", "t", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1")
    return found.join(least, "component", "left").select("doc_id", "t", F.coalesce("component_id", "doc_id").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies, that of the least id; rows without an id stay."""
    return _without(docs, near_copy_classes(docs.select("doc_id", "text")))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
