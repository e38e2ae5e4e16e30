"""Log-bilinear language model, trained with noise-contrastive estimation.

The context of a token is the two before it.  Its predicted vector is
``C1 r(w1) + C2 r(w2)``; a token scores its product with the token's vector plus a
bias.  The outputs are the ``WORDS`` most frequent words, the end token, and
``CLASSES`` classes of all other words (by their last two bytes).  Scoring
normalises over all outputs by batched matrix products; a word in a class has the
class's probability times ``(c + 1) / (sum of c + 1 in the class, plus 1)``, where the
last 1 is the share of all unknown words.  So every token has a normalised
probability over the training words and "unknown".

Training and statistics cover all training texts: word counts are summed over the
corpus; each task makes a pass of stochastic gradient over the tokens it reads,
starting from the same parameters, and the results are averaged with the tokens as
weights, ``ROUNDS`` times.  The model has a fixed size.  Counts of the most frequent
words (``HEAD`` at most) go to the tasks as a broadcast table; the others are joined.

Null text is empty (one end token); rows with null doc_id are in the training part;
equal rows are scored each; without training tokens every score is that of c = 0;
an empty table gives an empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import textvec as tv
from freightlens.llm.shared import table

WORDS, CLASSES, DIM = 768, 160, 16
HEAD = 200_000
ROUNDS = 2
BATCH, NOISE, RATE = 2048, 32, 0.1
END = np.uint64(0x5BD1E995A1B2C3D5)
_CLASS_MIX = np.uint64(0x100000001B3)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_class(w: tv.Words) -> np.ndarray:
    """The class of each word, from its last two bytes."""
    last = w.data[w.end - 1].astype(np.uint64)
    other = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (tv.mix((other << np.uint64(8) | last) * _CLASS_MIX) % np.uint64(CLASSES)).astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, c, n = (np.concatenate(x) for x in zip(*parts))
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return u, c[first], np.bincount(inverse, n, len(u)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words; what is held is given out when it has grown to a million words."""

    def out(u: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "cls", "n"])

    parts: list[tuple[np.ndarray, ...]] = []
    rows = held = 0
    for b in tv.slices(batches):
        w = tv.split_words(b.column(0))
        rows += b.num_rows
        if len(w.hash):
            u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            last = tv.Words(w.data, w.row_off, w.start[first], w.end[first], u, w.off)
            parts.append((u, word_class(last), n))
            held += len(u)
        if held > 1_000_000:
            parts = [_merge(parts)]
            held = len(parts[0][0])
            if held > 700_000:
                yield out(*parts.pop())
                held = 0
    if parts:
        yield out(*_merge(parts))
    if rows:
        yield out(np.array([END]), np.array([-1]), np.array([rows]))


@dataclass
class Vocabulary:
    """Counts of the frequent words, by descending count, and what the rest sums to."""

    hashes: np.ndarray
    counts: np.ndarray
    n: int  # all tokens
    v: int  # distinct
    class_mass: np.ndarray  # sum of c + 1 of the words in a class that are no outputs, plus 1

    @property
    def outputs(self) -> int:
        return min(WORDS, len(self.hashes)) + 1 + CLASSES

    def index(self) -> tv.HashIndex:
        x = tv.HashIndex()
        x.add(self.hashes)
        return x


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a table of all words' counts; at most HEAD rows go to the driver."""
    words = counts.where(F.col("cls") >= 0)
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    level = F.floor(F.log2("n") * 8)
    sizes = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    room, cut = HEAD, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        room -= r["words"]
        if room < 0:
            break
        cut = r["level"]
    # a level of very many equally frequent words may alone exceed HEAD; then these are joined, not broadcast
    head = words.where(level >= cut).select("h", "cls", "n").toArrow() if cut is not None else words.limit(0).select("h", "cls", "n").toArrow()
    h, c, n = head.column("h").to_numpy().view(np.uint64), head.column("cls").to_numpy(), head.column("n").to_numpy()
    order = np.lexsort((h, -n))
    h, c, n = h[order], c[order], n[order]
    mass = np.ones(CLASSES)
    for r in words.groupBy("cls").agg(F.sum(F.col("n") + 1).alias("m")).collect():
        mass[r["cls"]] += r["m"]
    np.subtract.at(mass, c[:WORDS], n[:WORDS] + 1)
    return Vocabulary(h, n.astype(np.int64), int(total["n"] or 0), int(total["v"]), mass)


@dataclass
class Model:
    """Context vectors r, position matrices, output vectors q and biases."""

    r: np.ndarray
    c1: np.ndarray
    c2: np.ndarray
    q: np.ndarray
    b: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.c1, self.c2, self.q, self.b]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> "Model":
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Model(*out)

    def predicted(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        return self.r[w1] @ self.c1 + self.r[w2] @ self.c2

    def log_norm(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Log of the sum of exp of all outputs' scores, for each context."""
        out = np.empty(len(w1))
        for at in range(0, len(w1), 2048):
            s = self.predicted(w1[at : at + 2048], w2[at : at + 2048]) @ self.q.T + self.b
            top = s.max(1)
            out[at : at + 2048] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def no_norms(self) -> np.ndarray:
        """Room for the normaliser of every context, for ``log_probs``."""
        return np.full((len(self.b) + 1) ** 2, np.nan)

    def log_probs(self, w1: np.ndarray, w2: np.ndarray, y: np.ndarray, norms: np.ndarray | None = None) -> np.ndarray:
        """Natural logs of the outputs' normalised probabilities.

        Each context is normalised once; ``norms`` keeps what was found over calls.
        """
        k = len(self.b) + 1
        norms = self.no_norms() if norms is None else norms
        pair, inverse = np.unique(w1 * k + w2, return_inverse=True)
        u1, u2 = pair // k, pair % k
        new = np.isnan(norms[pair])
        norms[pair[new]] = self.log_norm(u1[new], u2[new])
        vectors = self.predicted(u1, u2)
        s = np.einsum("ij,ij->i", vectors[inverse], self.q[y]) + self.b[y]
        return np.minimum(s - norms[pair][inverse], 0.0)


def unigram(v: Vocabulary, rows: int) -> np.ndarray:
    """Probabilities of the outputs: the end token, the words, the classes."""
    k = min(WORDS, len(v.hashes))
    p = np.concatenate(([rows + 1], v.counts[:k] + 1, v.class_mass)).astype(float)
    return p / p.sum()


def initial(v: Vocabulary, p: np.ndarray) -> Model:
    rng = np.random.default_rng(11)
    m = v.outputs
    eye = np.eye(DIM) * 0.5
    f = lambda x: x.astype(np.float32)
    return Model(f(rng.normal(0, 0.3, (m + 1, DIM))), f(eye), f(eye), f(rng.normal(0, 0.1, (m, DIM))), f(np.log(p)))


def token_ids(w: tv.Words, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Output ids of all tokens with an end token after each row, and their two contexts.

    ``found`` is each word's place in the vocabulary or -1.  The last array holds the
    tokens' positions of the words.
    """
    ids = np.where((found >= 0) & (found < k), found + 1, 0)
    tail = ids == 0
    cls = word_class(w) if len(w.hash) else np.zeros(0, np.int64)
    ids = np.where(tail, k + 1 + cls, ids)
    rows = len(w.off) - 1
    at = np.arange(len(ids)) + w.row
    y = np.zeros(len(ids) + rows, np.int64)
    y[at] = ids
    start = w.off[:-1] + np.arange(rows)
    before = k + 1 + CLASSES
    w1 = np.concatenate(([before], y[:-1]))
    w1[start] = before
    w2 = np.concatenate(([before], w1[:-1]))
    w2[start] = before
    return y, w1, w2, at


class Trainer:
    """AdaGrad steps of noise-contrastive estimation; a batch shares its noise."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.cum = np.cumsum(noise)
        self.log_kq = np.log(NOISE * noise)
        self.g2 = [np.full(p.shape, 0.1, np.float32) for p in model.parts()]

    @staticmethod
    def _rows(ids: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([np.bincount(ids, g[:, d], n) for d in range(g.shape[1])]).astype(np.float32)

    def step(self, w1: np.ndarray, w2: np.ndarray, y: np.ndarray) -> None:
        m, n = self.m, len(y)
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(m.b) - 1)
        r1, r2 = m.r[w1], m.r[w2]
        v = r1 @ m.c1 + r2 @ m.c2
        true = np.einsum("ij,ij->i", v, m.q[y]) + m.b[y] - self.log_kq[y]
        false = v @ m.q[noise].T + (m.b[noise] - self.log_kq[noise])
        gt = (-1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
        gf = (1 / (1 + np.exp(-np.clip(false, -30, 30)))).astype(np.float32)
        gv = gt[:, None] * m.q[y] + gf @ m.q[noise]
        gq = self._rows(y, gt[:, None] * v, len(m.b))
        np.add.at(gq, noise, gf.T @ v)
        gb = np.bincount(y, gt, len(m.b)).astype(np.float32)
        np.add.at(gb, noise, gf.sum(0))
        gr = self._rows(w1, gv @ m.c1.T, len(m.r)) + self._rows(w2, gv @ m.c2.T, len(m.r))
        for p, s, g in zip(m.parts(), self.g2, (gr, r1.T @ gv, r2.T @ gv, gq, gb)):
            g = g / np.float32(math.sqrt(n))
            s += g * g
            p -= RATE * g / np.sqrt(s)


def train(training: DataFrame, v: Vocabulary, rows: int, rounds: int = ROUNDS) -> Model:
    """Average of the tasks' models after a pass over all training tokens, ``rounds`` times."""
    noise = unigram(v, rows)
    model = initial(v, noise)
    k, block = min(WORDS, len(v.hashes)), 4096
    known = v.hashes[:k]

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            index = tv.HashIndex()
            index.add(known)
            t = Trainer(model.filled(model.flat()), noise, TaskContext.get().partitionId())
            tokens = 0
            for b in tv.slices(batches):
                w = tv.split_words(b.column(0))
                y, w1, w2, _ = token_ids(w, index.find(w.hash), k)
                for part in np.array_split(t.rng.permutation(len(y)), max(1, len(y) // BATCH)):
                    t.step(w1[part], w2[part], y[part])
                tokens += len(y)
            if tokens:
                flat = t.m.flat().astype(np.float64) * tokens
                parts = [flat[i : i + block] for i in range(0, len(flat), block)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary()), pa.array([tokens] * len(parts), pa.int64())], names=["block", "sums", "tokens"])

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = 0, 0
            for b in batches:
                for x, n in zip(b.column(b.schema.get_field_index("sums")).to_pylist(), b.column(b.schema.get_field_index("tokens")).to_pylist()):
                    total, tokens = total + np.frombuffer(x), tokens + n
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([(total / tokens).tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["block", "sums", "tokens"])

        schema = "block long, sums binary, tokens long"
        got = {r["block"]: r["sums"] for r in training.select("text").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()}
        if got:
            model = model.filled(np.concatenate([np.frombuffer(got[i]) for i in sorted(got)]))
    return model


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, lm double, tail_h array<long>, tail_n array<long>"


def score_rows(col: pa.Array, v: Vocabulary, index: tv.HashIndex, model: Model, rows: int, norms: np.ndarray | None = None) -> tuple:
    """Sums by row without the words that the broadcast table lacks, and those words."""
    w = tv.split_words(col)
    k = min(WORDS, len(v.hashes))
    found = index.find(w.hash)
    y, w1, w2, at = token_ids(w, found, k)
    lp = model.log_probs(w1, w2, y, norms) / math.log(10)
    log_c = np.where(found >= 0, np.log10(np.append(v.counts, 0)[found] + 1.0), 0.0)
    in_class = y[at] > k
    lp[at] += np.where(in_class, log_c - np.log10(v.class_mass[np.maximum(y[at] - k - 1, 0)]), 0.0)
    off = w.off + np.arange(len(w.off))
    n = np.diff(off)
    all_mass = math.log10(v.n + v.v + 1)
    base = tv.per_row(log_c, w.off) + math.log10(rows + 1) - n * all_mass
    known = tv.per_row((found >= 0).astype(np.int64), w.off) + (rows > 0)
    miss = found < 0
    h, row = w.hash[miss], w.row[miss]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    tail_off = np.searchsorted(row[first], np.arange(len(n) + 1))
    return n, known, base, tv.per_row(lp, off), h[first].view(np.int64), times, tail_off


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    tv.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    training = docs.where(~F.col("held_out")).select("text")
    counts = training.mapInArrow(count_words, "h long, cls int, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))
    counts = table(counts, "word-counts")
    v = vocabulary(counts)
    ends = counts.where(F.col("cls") < 0).agg(F.sum("n").alias("n")).first()["n"] or 0
    model = train(training, v, ends, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, rid, norms = v.index(), TaskContext.get().partitionId() << 36, model.no_norms()
        for b in tv.slices(batches):
            n, known, base, lm, tail_h, tail_n, off = score_rows(b.column(2), v, index, model, ends, norms)
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int64())) for x in (tail_h, tail_n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(n))), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(lm), *lists], names=[f.split()[0] for f in SCORED.split(", ")])
            rid += len(n)

    scored = table(docs.mapInArrow(run, SCORED), "lm-scored")
    tail = scored.select("rid", F.inline(F.arrays_zip("tail_h", "tail_n")).alias("h", "times"))
    seen = tail.join(counts.select("h", "n"), "h").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("part"))
    both = scored.drop("tail_h", "tail_n").join(seen, "rid", "left")
    part = F.coalesce(F.col("part"), F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base") + part).alias("base_score"), (F.col("lm") + part).alias("score"),
    )
