"""Document quality from random-indexing word vectors and a two-layer network with calibrated temperature.

Tokens (runs of letters, digits or other characters) are hashed to a fixed number of slots. Each slot has a sparse ternary index
vector; its context vector is the sum of the index vectors of its neighbours over all documents, counted in whole numbers, so the
result does not depend on how rows are dealt. Documents are pooled word vectors. A network of one hidden layer is fitted on a bounded
sample of labelled rows, its temperature on labelled rows the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_spans, column, map_arrow, map_rows, span_hashes, text_chunks

#: 0 separates tokens; letters include all bytes of characters outside ASCII.
TOKEN = np.full(256, 3, np.uint8)
TOKEN[:33] = 0
TOKEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
TOKEN[48:58] = 2


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows that are fitted on; counts of contexts cover all documents."""

    slots: int = 1 << 14
    dims: int = 32
    ones: int = 4
    window: int = 2
    sample: int = 20_000
    hidden: int = 32
    steps: int = 600
    threshold: float = 0.7
    seed: int = 7


def index_vectors(s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    out = np.zeros((s.slots, s.dims), np.int32)
    for k in range(s.ones):
        out[np.arange(s.slots), rng.integers(0, s.dims, s.slots)] += 1 if k % 2 else -1
    return out


def tokens(texts: pa.Array, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the tokens of some texts, and where each text begins among them (with the end)."""
    for _, _, buf, offsets in text_chunks(texts):
        starts, ends = class_spans(buf, offsets, TOKEN)
        slots = (span_hashes(buf, starts, ends) % np.uint64(s.slots)).astype(np.uint16 if s.slots <= 1 << 16 else np.int64)
        yield slots, np.searchsorted(starts, offsets)


def context_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """slot, n (its tokens) and c0, c1, ... (sums of its neighbours' index vectors) over every text."""
    names = [f"c{i}" for i in range(s.dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = index_vectors(s)
        sums, counts = np.zeros((s.slots, s.dims), np.int64), np.zeros(s.slots, np.int64)
        for batch in batches:
            for slots, cuts in tokens(column(batch, "text"), s):
                if not len(slots):
                    continue
                counts += np.bincount(slots, minlength=s.slots)
                vec = index[slots]
                around = np.zeros_like(vec)
                doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                for d in range(1, s.window + 1):
                    same = (doc[d:] == doc[:-d])[:, None]
                    around[d:] += vec[:-d] * same
                    around[:-d] += vec[d:] * same
                order = np.argsort(slots, kind="stable")
                found, at = np.unique(slots[order], return_index=True)
                sums[found] += np.add.reduceat(around[order], at, axis=0)
        used = np.flatnonzero(counts)
        yield {"slot": used, "n": counts[used]} | {c: sums[used, i] for i, c in enumerate(names)}

    parts = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "slot int, n long, " + ", ".join(f"{c} long" for c in names))
    return parts.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ["n", *names]))


def word_vectors(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """One row for each slot: its context direction without what all slots share, plus its own index vector. The table has a fixed
    size (``slots`` x ``dims``), whatever the corpus."""
    rows = context_counts(docs, s).collect()
    at = np.array([r["slot"] for r in rows], np.int64)
    n = np.array([r["n"] for r in rows], np.float64)
    counts = np.array([list(r)[2:] for r in rows], np.float64).reshape(-1, s.dims)
    out = np.zeros((s.slots, s.dims), np.float32)
    if len(rows):
        mean = counts / np.maximum(n, 1)[:, None]
        mean -= (mean * n[:, None]).sum(axis=0) / n.sum()
        out[at] = mean / np.maximum(np.linalg.norm(mean, axis=1), 1e-9)[:, None]
    return out + 0.25 * index_vectors(s).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """For each text the mean of its word vectors, their spread, and the mean step from a word to the next; zeros without tokens."""
    out, row = np.zeros((len(texts), 3 * s.dims), np.float32), 0
    for slots, cuts in tokens(texts, s):
        n = np.diff(cuts)
        full = np.flatnonzero(n)
        if len(full):
            v = vectors[slots]
            step = np.zeros_like(v)
            step[:-1] = np.abs(np.diff(v, axis=0))
            step[cuts[1:][full] - 1] = 0
            heads, size = cuts[:-1][full], n[full][:, None]
            mean = np.add.reduceat(v, heads, axis=0) / size
            spread = np.sqrt(np.maximum(np.add.reduceat(v * v, heads, axis=0) / size - mean * mean, 0))
            out[row + full] = np.hstack([mean, spread, np.add.reduceat(step, heads, axis=0) / np.maximum(size - 1, 1)])
        row += len(n)
    return out


@dataclass
class Network:
    """Two layers and a temperature; without weights every text has the score ``base``."""

    base: float
    weights: tuple[np.ndarray, ...] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.weights
        return np.tanh((x - mean) / scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, s: Settings) -> Network:
    """Adam on the rows outside ``held``, temperature by the likelihood of the rows in it. One class only, or no rows: no weights."""
    net = Network(float(y.mean()) if len(y) else 0.5)
    if len(np.unique(y[~held])) < 2:
        return net
    x, y = x.astype(np.float64), y.astype(np.float64)
    rng = np.random.default_rng(s.seed)
    xt, yt = x[~held], y[~held]
    mean, scale = xt.mean(axis=0), xt.std(axis=0) + 1e-6
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = (xt - mean) / scale
    for t in range(1, s.steps + 1):
        i = rng.integers(0, len(z), min(len(z), 512))
        h = np.tanh(z[i] @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - yt[i]) / len(i)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.weights = (mean, scale, *p)
    if held.any():
        logit = net.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
        loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, Network]:
    """Word vectors from all ``docs`` (doc_id, text) and a network from at most ``sample`` rows of ``labels`` (doc_id, quality).

    Labels other than 0 and 1 are ignored; an id that is labelled twice counts with its smaller label. The sample is the rows with the
    smallest hashes of their ids, every fifth of them by another hash is held for the temperature.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, s)
    shared = spark.sparkContext.broadcast(vectors)
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample).withColumn("held", F.pmod(F.xxhash64(F.lit(s.seed), "doc_id"), F.lit(5)) == 0)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = pooled(column(batch, "text"), shared.value, s)
            yield {"doc_id": column(batch, "doc_id"), "quality": column(batch, "quality"), "held": column(batch, "held"), "x": [r.tobytes() for r in x]}

    rows = map_arrow(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "quality", "held"), pool, "doc_id long, quality int, held boolean, x binary")
    # a repeated document counts once, so the sample stays bounded
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality", "held")).alias("r")).select("r.*").orderBy("x").collect()
    x = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), 3 * s.dims)
    return vectors, fit(x, np.array([r["quality"] for r in got], np.int64), np.array([r["held"] for r in got], bool), s)


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, s: Settings = Settings()) -> DataFrame:
    """doc_id, score (chance of label 1) and predicted for each row; null and empty texts are scored as texts without tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        w, n = shared.value
        for batch in batches:
            score = n.score(pooled(column(batch, "text"), w, s))
            yield {"doc_id": column(batch, "doc_id"), "score": score, "predicted": (score >= s.threshold).astype(np.int32)}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, predicted int")


def kept(docs: DataFrame, vectors: np.ndarray, net: Network, s: Settings = Settings()) -> DataFrame:
    """The rows whose text is predicted to be of quality, all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
        w, n = shared.value
        for batch in batches:
            yield batch.filter(pa.array(n.score(pooled(column(batch, text), w, s)) >= s.threshold))

    return map_rows(docs, run, "text")
