"""Quality classifier: random-indexing word vectors, pooled, and a small network.

1. Word vectors.  Every word (hashed to one of ``BUCKETS`` rows) sums the sparse
   random +1/-1 index vectors of its neighbours, over all documents' whole texts.
   Each task sums what it reads; the tasks' tables, of fixed size, are added up by
   blocks of rows.
2. Pooling.  A document's features are the mean of its words' unit vectors, its
   length, the mean's absolute parts and the share of distinct words and of a few
   character classes.
3. A network of two layers is trained in numpy on a bounded sample of labelled rows
   (``SAMPLE`` of them, those with the least hash of doc_id), part of which is held
   back to set the temperature that calibrates its probabilities.

Labels are read from rows whose crc32(doc_id as text) modulo 5 is not 0; labels,
lang, source and doc_id are never features.  Null and empty texts get the score of
zero features.  A table without labels scores 0.5 everywhere.

Defined cases: rows are scored one by one, so equal rows get equal scores and rows with equal
doc_id one each; a null doc_id is not held out and has no label.  Of several labels of a doc_id the
highest counts, null labels don't; rows with equal hash go by doc_id.  Very long texts are read whole.  An
empty table gives an empty result; columns besides doc_id, text and the labels' doc_id and quality are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import textvec as tv

BUCKETS, DIM, NEAR, BLOCK = 8192, 32, 2, 512
SAMPLE = 20_000
HIDDEN = 32


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Two lanes and their signs for each bucket."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIM, (2, BUCKETS)), rng.choice([-1.0, 1.0], (2, BUCKETS))


def context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of neighbours' index vectors over a task's rows, by block of buckets."""
    lane, sign = _index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for b in tv.slices(batches):
        w = tv.split_words(b.column(0))
        k, row = _bucket(w.hash), w.row
        for d in range(1, NEAR + 1):
            same = row[d:] == row[:-d]
            left, right = k[:-d][same], k[d:][same]
            for a, c in ((left, right), (right, left)):
                for j in range(2):
                    total += np.bincount(a * DIM + lane[j, c], sign[j, c], BUCKETS * DIM)
    t = total.reshape(-1, BLOCK * DIM)
    blocks = np.flatnonzero(np.abs(t).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([x.astype("<f4").tobytes() for x in t[blocks]], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from all documents; at most BUCKETS * DIM numbers reach the driver."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK * DIM)
        for b in batches:
            for x in b.column(b.schema.get_field_index("sums")).to_pylist():
                total += np.frombuffer(x, "<f4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])

    got = docs.select("text").mapInArrow(context_sums, "block long, sums binary").groupBy("block").applyInArrow(add, "block long, sums binary").collect()
    out = np.zeros((BUCKETS, DIM))
    for r in got:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], "<f4").reshape(-1, DIM)
    out = np.sign(out) * np.log1p(np.abs(out))  # frequent neighbours count less than in proportion
    out -= out.mean(0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


FEATURES = 2 * DIM + 6


def pooled(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text."""
    w = tv.split_words(col, lower=False)
    lower = tv.split_words(col)
    n = np.diff(w.off).astype(float)
    some = np.maximum(n, 1)
    k = _bucket(lower.hash)
    v = np.concatenate((np.zeros((1, DIM), np.float32), vectors[k]))
    at = np.minimum(lower.off[:-1], max(len(k) - 1, 0)) + 1
    mean = np.add.reduceat(v, at, axis=0).astype(float) if len(k) else np.zeros((len(n), DIM))
    mean[n == 0] = 0
    mean /= some[:, None]
    row = w.row
    distinct = np.zeros(len(n))
    if len(k):
        order = np.lexsort((lower.hash, row))
        h, r = lower.hash[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        distinct = np.bincount(r[new], minlength=len(n)).astype(float)
    data = w.data
    classes = []
    for test in ((data >= 65) & (data <= 90), (data >= 48) & (data <= 57), (data < 128) & ~tv._LETTER[data] & ~tv._WS[data]):
        classes.append(tv.per_row(test.astype(np.int64), w.row_off) / np.maximum(np.diff(w.row_off), 1))
    size = np.diff(w.row_off) / some
    return np.column_stack((mean, np.abs(mean), np.log1p(n) / 8, distinct / some, np.minimum(size, 20) / 10, *classes))


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on log loss with weight decay; a fifth of the rows only sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[used].mean(0), x[used].std(0) + 1e-6, rng.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0)
    z = np.clip((x - net.mean) / net.scale, -6, 6)
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
            a = np.tanh(z[i] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3][0], -30, 30))) - y[i]) / len(i)
            back = np.outer(d, p[2]) * (1 - a * a)
            t += 1
            for j, g in enumerate((z[i].T @ back + 1e-4 * p[0], back.sum(0), a.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        logit = net.logit(x[held])
        loss = lambda s: np.logaddexp(0, np.where(y[held] > 0.5, -1, 1) * logit / s).mean()
        net.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss))
    return net


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def sample_features(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training rows with the least hash, ``sample`` at most."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold("doc_id") != 0).select("doc_id", F.col("quality").cast("double").alias("y"))
    some = some.groupBy("doc_id").agg(F.max("y").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most 16 bytes times the sample
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            x = pooled(b.column(0), vectors).astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], names=["x", "y"])

    got = sorted((bytes(r["x"]), r["y"]) for r in rows.mapInArrow(run, "x binary, y double").collect())
    return np.array([np.frombuffer(x, "<f4") for x, _ in got], float).reshape(-1, FEATURES), np.array([y for _, y in got])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    tv.bounded_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    x, y = sample_features(docs, labels, vectors, sample)
    net = train(x, y) if len(set(y)) == 2 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            p = net.probability(pooled(b.column(2), vectors)) if net else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)
