"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a hashed word embedding plus the mean embedding of its hashed
character (byte) n-grams. The network reads windows of WINDOW words, one every
STRIDE words, so that neighbours overlap and any passage of up to WINDOW - STRIDE words
lies whole in one of them; attention weighs its states, and the pooled state gives the
window's logit. A document's score is that of its highest window; every window of every
whole text is scored.

Training takes at most MAX_TOXIC + MAX_CLEAN labelled documents (those with the least
hash of the id in each class) that are not held out, one row an id, without those over
MAX_TEXT bytes, as far as they have MAX_BYTES together, so the fit costs the same at any
size. A document's label holds for its highest window: each epoch scores all windows
of the sample and takes a gradient step on the highest of each document (and on a
second one of clean documents). The first embedding dimension starts from the log odds
of the word or n-gram in the sample, the rest at random. A fifth of the sample only sets the bias:
THRESHOLD falls midway between the highest clean and the lowest toxic scores there.

Defined cases: null and empty texts have one window without words and its score; if
the sample lacks a class every score is 0; repeated rows are scored alike; a null id
is never held out nor used for training; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, STRIDE = 32, 16
DIM, HIDDEN = 12, 8
BUCKETS = 1 << 15
NGRAMS = (4, 5)
#: The bounds of the training sample: documents of each class, UTF-8 bytes of one and of all.
MAX_TOXIC, MAX_CLEAN, MAX_TEXT, MAX_BYTES = 1000, 1500, 512 << 10, 32 << 20
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Gradient steps at least; a small sample gets more epochs.
STEPS = 150
THRESHOLD = 0.3
#: Words whose inputs a worker keeps before it starts anew.
CACHE = 100_000
_EDGES = b".,;:!?\"'()[]{}<>*%$&#|-"


def normal_words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().split()


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, n-gram buckets and, for each n-gram, the place of its word."""
    cores = [w.strip(_EDGES) or w for w in words]
    sizes = np.asarray([len(c) + 2 for c in cores], np.int64)
    data = np.frombuffer(b"".join(b"\x02" + c + b"\x03" for c in cores), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(cores)), sizes)
    ends = np.cumsum(sizes)
    mult = np.uint64(0x9E3779B97F4A7C15)
    word = np.asarray([zlib.crc32(c) for c in cores], np.uint64) % np.uint64(BUCKETS)
    grams, owners = [], []
    for n in NGRAMS:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + data[k : len(data) - n + 1 + k]
        at = np.arange(len(code))
        inside = at + n <= ends[of[at]]
        grams.append(((code[inside] * mult) >> np.uint64(64 - 15)).astype(np.int64))
        owners.append(of[at[inside]])
    grams, owners = (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(owners, kind="stable")
    return word.astype(np.int32), grams[order].astype(np.int32), owners[order].astype(np.int32)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, places) of all overlapping windows; places are into the concatenated words, -1 past a text's end."""
    first = np.r_[0, np.cumsum(sizes)]
    count = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(sizes)), count)
    begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    place = begin[:, None] + np.arange(WINDOW)
    return doc, np.where(place < sizes[doc][:, None], place + first[doc][:, None], -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name; every array is float32."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": draw(BUCKETS, DIM, scale=0.05), "gram": draw(BUCKETS, DIM, scale=0.05), "att": draw(2 * HIDDEN, scale=0.3), "out": draw(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            p |= {f"W{side}": draw(DIM, 3 * HIDDEN, scale=0.3), f"U{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        return Network(p)

    def inputs(self, features: tuple[np.ndarray, np.ndarray, np.ndarray], block: int = 20_000) -> np.ndarray:
        word, gram, owner = features
        x = self.p["word"][word]
        for i in range(0, len(word), block):  # the n-grams' embeddings of a few words at once
            a, b = np.searchsorted(owner, (i, i + block))
            if a < b:
                own = owner[a:b]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                n = np.diff(np.r_[starts, len(own)])
                x[own[starts]] += np.add.reduceat(self.p["gram"][gram[a:b]], starts, axis=0) / n[:, None].astype(np.float32)
        return x

    def gates(self, x: np.ndarray) -> np.ndarray:
        """Input part of the gates of both directions; a last row, for no word, keeps the state as it is."""
        H = HIDDEN
        g = np.zeros((len(x) + 1, 6 * H), np.float32)
        for d, side in enumerate("fb"):
            np.matmul(x, self.p[f"W{side}"], out=g[:-1, 3 * H * d : 3 * H * (d + 1)])
            g[:-1, 3 * H * d : 3 * H * (d + 1)] += self.p[f"c{side}"]
            g[-1, 3 * H * d : 3 * H * d + H] = 60
        return g

    def forward(self, gates: np.ndarray, place: np.ndarray, keep: bool = False):
        """Logits of windows; place: rows of gates, -1 for no word. keep: also what backward() needs."""
        n, steps = place.shape
        H = HIDDEN
        states = np.zeros((2, steps, n, H), np.float32)
        kept = []
        for d, side in enumerate("fb"):
            U = self.p[f"U{side}"]
            h = np.zeros((n, H), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g = gates[place[:, t], 3 * H * d : 3 * H * (d + 1)]
                u = h @ U
                zr = sigmoid(g[:, : 2 * H] + u[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(g[:, 2 * H :] + r * u[:, 2 * H :])
                if keep:
                    kept.append((d, t, h, z, r, c, u[:, 2 * H :]))
                h = c + z * (h - c)
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], axis=2)  # steps x n x 2H
        e = both @ self.p["att"]
        e = np.where(place.T >= 0, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a *= place.T >= 0
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", a, both)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (both, a, pooled, kept)) if keep else logit

    def backward(self, place: np.ndarray, error: np.ndarray, memory) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients by name (without the embeddings), and of the gates at each place (steps x n x 6H)."""
        both, a, pooled, kept = memory
        H, p = HIDDEN, self.p
        n, steps = place.shape
        grad = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        grad["out"], grad["bias"][0] = pooled.T @ error, error.sum()
        d_pooled = error[:, None] * p["out"]
        d_a = np.einsum("nk,tnk->tn", d_pooled, both)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        grad["att"] = np.einsum("tn,tnk->k", d_e, both)
        d_both = a[:, :, None] * d_pooled + d_e[:, :, None] * p["att"]
        d_gates = np.zeros((steps, n, 6 * H), np.float32)
        carry = {0: np.zeros((n, H), np.float32), 1: np.zeros((n, H), np.float32)}
        for d, t, h, z, r, c, u in reversed(kept):
            side = "fb"[d]
            U = p[f"U{side}"]
            dh = carry[d] + d_both[t, :, H * d : H * (d + 1)]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            grad[f"U{side}"] += h.T @ du
            carry[d] = dh * z + du @ U.T
            d_gates[t, :, 3 * H * d : 3 * H * (d + 1)] = np.concatenate([dz, dr, dc], axis=1)
        return grad, d_gates

    def logits(self, gates: np.ndarray, rows: np.ndarray, block: int = 2048) -> np.ndarray:
        """forward() without what training needs; arrays hold a unit's values for all windows side by side."""
        H, p = HIDDEN, self.p
        half = np.ones((3 * H, 1), np.float32)
        half[: 2 * H] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        U = [np.ascontiguousarray(p[f"U{d}"].T * half) for d in "fb"]
        scale = np.concatenate([half, half])[:, 0]
        out = np.empty(len(rows), np.float32)
        att, last = p["att"], len(gates) - 1
        for i in range(0, len(rows), block):
            place = np.ascontiguousarray(rows[i : i + block].T)
            steps, n = place.shape
            there = place >= 0
            place = np.where(there, place, last)
            states = np.empty((steps, 2 * H, n), np.float32)
            for d in (0, 1):
                h = np.zeros((H, n), np.float32)
                for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                    g = np.ascontiguousarray((gates[place[t], 3 * H * d : 3 * H * (d + 1)] * scale[: 3 * H]).T)
                    u = U[d] @ h
                    zr = g[: 2 * H]
                    zr += u[: 2 * H]
                    np.tanh(zr, out=zr)
                    zr *= 0.5
                    zr += 0.5
                    c, uc = g[2 * H :], u[2 * H :]
                    uc *= zr[H:]
                    c += uc
                    np.tanh(c, out=c)
                    h -= c
                    h *= zr[:H]
                    h += c
                    states[t, H * d : H * (d + 1)] = h
            e = np.tensordot(att, states, axes=(0, 1))
            e[~there] = -1e9
            a = np.exp(e - e.max(axis=0))
            a *= there
            a /= np.maximum(a.sum(axis=0), 1e-9)
            value = np.tensordot(p["out"], states, axes=(0, 1))
            out[i : i + block] = (value * a).sum(axis=0) + p["bias"][0]
        return out

    def document_scores(self, gates: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Highest logit of each document's windows; words: row of gates of each word."""
        doc, place = windows(sizes)
        logit = self.logits(gates, np.where(place >= 0, np.r_[words, -1][place], -1))
        return np.maximum.reduceat(logit, np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]))


def fit(texts: list[bytes], toxic: np.ndarray) -> Network | None:
    """train() on four fifths of the documents, the bias from the others; None if a class is missing."""
    apart = np.asarray([zlib.crc32(t) % 5 == 0 for t in texts], bool)
    use = [i for i in range(len(texts)) if not apart[i]]
    net = train([texts[i] for i in use], toxic[use])
    check = [i for i in range(len(texts)) if apart[i]]
    if net is None:
        return train(texts, toxic)
    score = Scorer(net).scores([texts[i] for i in check]) if check else np.zeros(0)
    logit, y = np.log(np.clip(score, 1e-9, 1 - 1e-9) / (1 - np.clip(score, 1e-9, 1 - 1e-9))), toxic[check]
    if (y == 1).sum() >= 20 and (y == 0).sum() >= 20:
        middle = (np.quantile(logit[y == 1], 0.02) + np.quantile(logit[y == 0], 0.995)) / 2
        net.p["bias"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD)) - middle)
    return net


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 7) -> Network | None:
    """A network fitted to the documents; None if a class is missing."""
    if not len(texts) or toxic.min() == toxic.max():
        return None
    rng = np.random.default_rng(seed)
    net = Network.fresh(seed)
    split = [normal_words(t) for t in texts]
    sizes = np.asarray([len(w) for w in split], np.int64)
    row: dict[bytes, int] = {}
    words = np.asarray([row.setdefault(w, len(row)) for ws in split for w in ws], np.int64)
    features = word_features(list(row)) if row else (np.zeros(0, np.int64),) * 3
    word, gram, owner = features
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    seen = np.unique(doc_of * np.int64(max(1, len(row))) + words)
    d_seen, w_seen = seen // max(1, len(row)), seen % max(1, len(row))
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()

    def odds(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log odds of buckets from (bucket, document), all of a document's in one part."""
        c1, c0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for unit, doc in pairs:
            pair = np.unique(unit * np.int64(len(texts)) + doc)
            u, y = pair // len(texts), toxic[pair % len(texts)]
            c1 += np.bincount(u, weights=y, minlength=BUCKETS)
            c0 += np.bincount(u, weights=1 - y, minlength=BUCKETS)
        r1, r0 = (c1 + 0.5) / (n1 + 1), (c0 + 0.5) / (n0 + 1)
        return np.clip(np.log(r1 / r0) * (c1 + c0) / (c1 + c0 + 8), -3, 3)

    first = np.searchsorted(owner, np.arange(len(row)))
    many = np.diff(np.r_[first, len(owner)])

    def gram_pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for d in range(0, len(texts), 100):
            a, b = np.searchsorted(d_seen, (d, d + 100))
            w, n = w_seen[a:b], many[w_seen[a:b]]
            at = np.repeat(first[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield gram[at], np.repeat(d_seen[a:b], n)

    net.p["word"][:, 0] = odds(iter([(word[w_seen], d_seen)]))
    net.p["gram"][:, 0] = odds(gram_pairs())
    # All places where the first inputs are high start as evidence, in both directions.
    for side in "fb":
        net.p[f"W{side}"][0, 2 * HIDDEN :] = np.abs(net.p[f"W{side}"][0, 2 * HIDDEN :])
    doc, place = windows(sizes)
    rows = np.where(place >= 0, np.r_[words, -1][place], -1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items() if k not in ("word", "gram")}
    squares = {k: np.full(BUCKETS, 1e-3, np.float32) for k in ("word", "gram")}
    x_row = net.inputs(features)[:, 0]
    logit = np.where(rows >= 0, x_row[rows], 0).max(axis=1)  # the first choice of windows: by the log odds
    step, epoch = 0, 0
    while epoch < EPOCHS or step < STEPS:
        if epoch:
            gates = net.gates(net.inputs(features))
            logit = net.logits(gates, rows)
        order = np.lexsort((-logit, doc))
        nth = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        taken = order[(nth == 0) | (nth <= 2) & (toxic[doc[order]] == 0)]
        taken = taken[rng.permutation(len(taken))]
        epoch += 1
        ratio = np.float32(min(8.0, (toxic[doc[taken]] == 0).sum() / max(1, (toxic[doc[taken]] == 1).sum())))
        for i in range(0, len(taken), BATCH):
            step += 1
            w = taken[i : i + BATCH]
            ids, local = np.unique(rows[w], return_inverse=True)
            local = local.reshape(rows[w].shape)
            if ids[0] < 0:
                ids, local = ids[1:], local - 1
            part = _subset(features, ids, first, many)
            x = net.inputs(part)
            out, memory = net.forward(net.gates(x), local, keep=True)
            weight = np.where(toxic[doc[w]] == 1, ratio, np.float32(1))  # both classes weigh alike
            error = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - toxic[doc[w]]) * weight / weight.sum()).astype(np.float32)
            grad, d_gates = net.backward(local, error, memory)
            flat, real = d_gates.reshape(-1, 6 * HIDDEN), local.T.reshape(-1)
            d_x_gates = np.zeros((len(ids), 6 * HIDDEN), np.float32)
            np.add.at(d_x_gates, real[real >= 0], flat[real >= 0])
            dx = np.zeros_like(x)
            for d, side in enumerate("fb"):
                g = d_x_gates[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
                grad[f"W{side}"], grad[f"c{side}"] = x.T @ g, g.sum(axis=0)
                dx += g @ net.p[f"W{side}"].T
            for k, g in grad.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            pw, pg, po = part
            n_of = np.bincount(po, minlength=len(ids))
            for k, at, g in (("word", pw, dx), ("gram", pg, dx[po] / n_of[po][:, None].astype(np.float32))):
                u, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(u), DIM), np.float32)
                np.add.at(total, inverse, g.astype(np.float32))
                squares[k][u] += (total**2).mean(axis=1)
                net.p[k][u] -= 0.02 * total / np.sqrt(squares[k][u])[:, None]
    return net


def _subset(features, ids: np.ndarray, first: np.ndarray, many: np.ndarray):
    word, gram, _ = features
    n = many[ids]
    at = np.repeat(first[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return word[ids], gram[at], np.repeat(np.arange(len(ids)), n)


class Scorer(dict):
    """A worker's network; as a dict it numbers the words it has seen, whose gate inputs it keeps."""

    def __init__(self, net: Network):
        self.net, self.fresh = net, []
        self.gates = net.gates(np.zeros((0, DIM), np.float32))

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def scores(self, texts: list[bytes]) -> np.ndarray:
        split = [normal_words(t) for t in texts]
        if len(self) > CACHE:
            self.clear()
            self.gates = self.gates[-1:]
        words = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64)
        if self.fresh:
            new = [self.net.gates(self.net.inputs(word_features(self.fresh[i : i + 20_000])))[:-1] for i in range(0, len(self.fresh), 20_000)]
            self.gates = np.concatenate([self.gates[:-1], *new, self.gates[-1:]])
            self.fresh = []
        logit = self.net.document_scores(self.gates, words, np.asarray([len(w) for w in split], np.int64))
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def held_out(ident: Column) -> Column:
    """Rows that no training sees: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[list[bytes], np.ndarray]:
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [usable.filter(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in ((1, max_toxic), (0, max_clean))]
    chosen = F.broadcast(some[0].union(some[1]))  # max_toxic + max_clean rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).filter(F.octet_length("text") <= MAX_TEXT).join(chosen, "doc_id")
    # One row an id before any text is gathered: aggregated within the tasks first.
    one = found.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("r")).select("doc_id", "r.*")
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = one.withColumn("upto", upto).filter(F.col("upto") <= MAX_BYTES).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id", kind="stable")
    return [t.encode() for t in rows["text"]], rows["toxic"].to_numpy(np.float32)


SCORES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _fitted(docs: DataFrame, labels: DataFrame):
    net = fit(*training_sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(None if net is None else net.p)  # 2 * BUCKETS * DIM numbers

    def scorer():
        network = Scorer(Network(shared.value)) if shared.value is not None else None
        # A scorer is a dict, empty at first: compare with None.
        return lambda column: np.zeros(len(column)) if network is None else network.scores(common.text_bytes(column))

    return scorer


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of each row of docs, from a network fitted to the labels."""
    scorer = _fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in common.sliced(batches, "text", 1 << 20):
            yield pa.record_batch([batch.column(0), pa.array(score(batch.column(1)))], names=SCORES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, as they are."""
    scorer, at = _fitted(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in common.sliced(batches, "text", 1 << 20):
            yield batch.filter(pa.array(score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
