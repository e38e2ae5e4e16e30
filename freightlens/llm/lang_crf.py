"""Language identification of words by a linear-chain conditional random field.

Every word is labelled with a language; a label's score is the sum of weights of the
word's affixes (first and last 1 to 3 bytes), all its byte trigrams and its lexicon
entry, plus a learned transition weight from the label before.  A run without spaces of more
than ``LONG + 3`` bytes counts as several words, ``LONG`` bytes or a little less or
more each, cut between characters; they cover all of it, but for trigrams across a cut.  Forward-backward
gives each word's marginals, so code-switched texts get a language per word; a text's
language is the one with the largest sum of marginals over its words with a letter.

The lexicon holds, for hashed words, the log share of each language in all training
texts (``lexicon_rows`` hash rows; every task sums its own counts).  The field's
weights are fitted in numpy by stochastic gradient on a bounded sample of training
rows (``SAMPLE`` rows of each language, those with the least hash of doc_id, and
``SAMPLE_WORDS`` words of each from a hashed place), from
whose texts code-switched sequences of several languages are put together, so that
transitions are learned too: ``SEQUENCES``, or ``LANG_SEQUENCES`` for each language if that is
more.  Every lang value of the training rows is a language; weights and the lexicon
have a column for each, so memory grows with their number.

Training rows have a text, a lang and crc32(doc_id as text) modulo 4 other than 2;
lang, source and doc_id are never features.  A text that is null or has no letter is
``und`` with score 0; without training rows all are.  Rows are independent: equal rows get
equal predictions, rows with equal doc_id one each.  A null doc_id is not held out.  Languages with equal
sums go by name, sampled rows with equal hash by doc_id and text.  Very long texts are read
whole when they are labelled.  An empty table gives an empty result; columns besides doc_id, text and lang
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import textvec as tv

SAMPLE, SAMPLE_WORDS = 400, 200
ROWS_BITS, LEXICON_BITS = 15, 15
#: Languages whose sample is taken in one job, and sequences the field is fitted on: in all and for each language, at least.
LANGS_AT_ONCE, SEQUENCES, LANG_SEQUENCES = 32, 6000, 100
AFFIXES, LONG = 6, 32
#: Words whose trigrams are summed at once.
BLOCK = 2048
CHUNK = 4 << 20


def _rows(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def cut_words(w: tv.Words) -> tv.Words:
    """The words, long runs as consecutive words."""
    size = w.end - w.start
    pieces = np.where(size > LONG + 3, -(-size // LONG), 1)
    total = np.concatenate(([0], np.cumsum(pieces)))
    if total[-1] == len(size):
        return w
    at = np.arange(total[-1]) - np.repeat(total[:-1], pieces)
    start = np.repeat(w.start, pieces) + LONG * at
    for _ in range(3):  # back to the character's first byte
        start -= (at > 0) & ((w.data[start] & 0xC0) == 0x80)
    until = np.append(start[1:], len(w.data))
    end = until.copy()
    end[total[1:] - 1] = w.end
    return tv.Words(w.data, w.row_off, start, end, tv._word_hash(w.data, start, until, end), total[w.off])


def split_words(col: pa.Array) -> tv.Words:
    return cut_words(tv.split_words(col))


def affixes(w: tv.Words, at: np.ndarray) -> np.ndarray:
    """Hashed feature rows of the affixes of the words at these positions, AFFIXES each; row 0 is unused."""
    start, size = w.start[at], (w.end - w.start)[at]
    d = np.concatenate((w.data, np.zeros(8, np.uint8)))
    out = np.zeros((len(at), AFFIXES), np.int32)
    for j in range(3):
        first, last = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for i in range(j + 1):
            first = first * np.uint64(257) + d[start + i] + np.uint64(1)
            last = last * np.uint64(257) + d[np.maximum(start + size - 1 - i, 0)] + np.uint64(1)
        ok = size > j
        out[:, 2 * j] = np.where(ok, _rows(tv.mix(first + np.uint64((2 * j + 1) << 40)), ROWS_BITS), 0)
        out[:, 2 * j + 1] = np.where(ok, _rows(tv.mix(last + np.uint64((2 * j + 2) << 40)), ROWS_BITS), 0)
    return out


def trigrams(w: tv.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature rows of all byte trigrams of the words at these positions, and how many each word has."""
    n = np.maximum((w.end - w.start)[at] - 2, 0)
    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - w.start[at], n)
    v = (w.data[p].astype(np.uint64) << np.uint64(16)) | (w.data[p + 1].astype(np.uint64) << np.uint64(8)) | w.data[p + 2].astype(np.uint64)
    return _rows(tv.mix(v + np.uint64(9 << 40)), ROWS_BITS), n


def emissions(emission: np.ndarray, w: tv.Words, at: np.ndarray) -> np.ndarray:
    """Sums of the feature rows' weights of the words at these positions."""
    out = emission[affixes(w, at)].sum(1)
    for a in range(0, len(at), BLOCK):
        rows, n = trigrams(w, at[a : a + BLOCK])
        some = np.flatnonzero(n)
        if len(some):
            out[a + some] += np.add.reduceat(emission[rows], (np.cumsum(n) - n)[some])
    return out


def has_letter(w: tv.Words) -> np.ndarray:
    """Whether each row holds a letter; bytes beyond ASCII are looked at as characters."""
    out = tv.per_row(tv._LETTER[w.data].astype(np.int64), w.row_off) > 0
    for i in np.flatnonzero(~out & (tv.per_row((w.data >= 128).astype(np.int64), w.row_off) > 0)).tolist():
        out[i] = any(c.isalpha() for c in w.data[w.row_off[i] : w.row_off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Field:
    """Weights: emission by feature row and label, lexicon scale, transitions, starts."""

    langs: list[str]
    emission: np.ndarray
    lexicon: np.ndarray  # log shares by hash row and label
    scale: float
    move: np.ndarray

    def scores(self, w: tv.Words) -> np.ndarray:
        """Each word's label scores; equal words are scored once."""
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        s = emissions(self.emission, w, first) + self.scale * self.lexicon[_rows(w.hash[first], LEXICON_BITS)]
        return s[inverse]


def forward_backward(scores: np.ndarray, off: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and forward messages, of chains scores[off[i]:off[i+1]].

    All chains advance together; longer ones are put first, so those still running
    are a prefix.
    """
    k = scores.shape[1]
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    base, n = off[:-1][order], size[order]
    running = np.searchsorted(-n, -np.arange(int(n[0]) + 1 if len(n) else 1), side="left")  # chains longer than t
    e = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
    m = np.exp(move - move.max())
    alpha = np.empty_like(e)
    a = np.full((len(n), k), 1.0 / k)
    for t in range(int(n[0]) if len(n) else 0):
        r = running[t]
        at = base[:r] + t
        a = (a[:r] @ m if t else a[:r]) * e[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    post = np.empty_like(e)
    b = np.ones((len(n), k))
    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        r = running[t]
        at = base[:r] + t
        x = b[:r]
        p = alpha[at] * x
        post[at] = p / p.sum(1, keepdims=True)
        x = (x * e[at]) @ m.T
        b[:r] = x / x.sum(1, keepdims=True)
    return post, alpha


def lexicon_counts(langs: list[str]):
    """Counts of hashed words by language, one table of fixed size for each task."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, k = 1 << LEXICON_BITS, len(langs)
        total = np.zeros(rows * k, np.int64)
        for b in tv.slices(batches):
            w = split_words(b.column(0))
            lang = np.array([number.get(x, -1) for x in b.column(1).to_pylist()], np.int64)[w.row]
            at = _rows(w.hash, LEXICON_BITS).astype(np.int64) * k + lang
            total += np.bincount(at[lang >= 0], minlength=rows * k)
        t = total.reshape(-1, 1024 * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(t)), pa.int64()), pa.array([x.astype("<i8").tobytes() for x in t], pa.binary())], names=["block", "counts"])

    return run


def lexicon(training: DataFrame, langs: list[str]) -> np.ndarray:
    k = len(langs)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1024 * k, np.int64)
        for b in batches:
            for x in b.column(b.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    got = training.select("text", "lang").mapInArrow(lexicon_counts(langs), "block long, counts binary").groupBy("block").applyInArrow(add, "block long, counts binary").collect()
    c = np.zeros((1 << LEXICON_BITS, k))
    for r in got:
        c[r["block"] * 1024 : (r["block"] + 1) * 1024] = np.frombuffer(r["counts"], "<i8").reshape(-1, k)
    share = (c + 0.5) / (c.sum(0) + 0.5 * len(c))
    out = np.log(share)
    return out - out.mean(1, keepdims=True)


def _sequences(texts: list[tuple[str, int]], rng: np.random.Generator, count: int) -> tuple[list[str], list[np.ndarray]]:
    """Code-switched sequences: runs of words from texts of one or more languages."""
    spans = []
    for t, y in texts:
        w = split_words(pa.array([t], pa.large_string()))
        raw = w.data.tobytes()
        spans += [([raw[a:b].decode() for a, b in zip(w.start.tolist(), w.end.tolist())], y)] if len(w.start) else []
    out, labels = [], []
    for _ in range(count if spans else 0):
        words: list[str] = []
        y: list[int] = []
        for _ in range(int(rng.integers(1, 4))):
            w, lang = spans[int(rng.integers(len(spans)))]
            n = int(rng.integers(3, 40))
            at = int(rng.integers(max(1, len(w) - n + 1)))
            words += w[at : at + n]
            y += [lang] * len(w[at : at + n])
        out.append(" ".join(words))
        labels.append(np.array(y))
    return out, labels


def fit(texts: list[tuple[str, int]], langs: list[str], lex: np.ndarray, sequences: int = SEQUENCES, epochs: int = 4, rate: float = 0.15, seed: int = 5) -> Field:
    """Stochastic gradient on the conditional log likelihood (AdaGrad steps)."""
    rng, k = np.random.default_rng(seed), len(langs)
    field = Field(langs, np.zeros((1 << ROWS_BITS, k)), lex, 0.1, np.zeros((k, k)))
    g2e, g2m, g2s = np.full_like(field.emission, 1e-2), np.full((k, k), 1e-2), 1e-2
    seqs, labels = _sequences(texts, rng, sequences)
    for epoch in range(epochs):
        for i in np.array_split(rng.permutation(len(seqs)), max(1, len(seqs) // 64)):
            w = split_words(pa.array([seqs[j] for j in i], pa.large_string()))
            y = np.concatenate([labels[j] for j in i]) if len(i) else np.zeros(0, int)
            if len(w.hash) != len(y) or len(y) == 0:
                continue
            every = np.arange(len(w.hash))
            x, (tri, n_tri) = affixes(w, every), trigrams(w, every)
            lx = lex[_rows(w.hash, LEXICON_BITS)]
            s = emissions(field.emission, w, every) + field.scale * lx
            post, alpha = forward_backward(s, w.off, field.move)
            err = post.copy()
            err[np.arange(len(y)), y] -= 1
            err /= len(y)
            # pair marginals from the messages: p(a, b) = alpha(a) * m(a, b) * post(b) / (alpha m)(b)
            later = np.ones(len(y), bool)
            later[w.off[:-1][np.diff(w.off) > 0]] = False
            to = np.flatnonzero(later)
            m = np.exp(field.move - field.move.max())
            gm = m * (alpha[to - 1].T @ (post[to] / (alpha[to - 1] @ m)))
            np.add.at(gm, (y[to - 1], y[to]), -1.0)
            gm /= len(y)
            # only the rows that are met change
            met, place = np.unique(np.concatenate((x.ravel(), tri)), return_inverse=True)
            ge = np.zeros((len(met), k))
            np.add.at(ge, place[: x.size], np.repeat(err, AFFIXES, axis=0))
            np.add.at(ge, place[x.size :], np.repeat(err, n_tri, axis=0))
            ge[met == 0] = 0
            gs = float((err * lx).sum())
            g2e[met] += ge * ge
            g2m += gm * gm
            g2s += gs * gs
            field.emission[met] -= rate * ge / np.sqrt(g2e[met])
            field.move -= rate * gm / np.sqrt(g2m)
            field.scale -= rate * gs / g2s**0.5
    return field


def label_rows(col: pa.Array, field: Field | None) -> tuple[list[str], np.ndarray]:
    """Each text's language and its share of the marginals."""
    w = split_words(col)
    rows = len(w.row_off) - 1
    letters = has_letter(w)
    if field is None or len(w.hash) == 0:
        return ["und"] * rows, np.zeros(rows)
    post, _ = forward_backward(field.scores(w), w.off, field.move)
    letter = (tv._LETTER | (np.arange(256) >= 128))[w.data]
    c = np.concatenate(([0], np.cumsum(letter)))
    post *= (c[w.end] > c[w.start])[:, None]
    total = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)))
    sums = np.maximum(total[w.off[1:]] - total[w.off[:-1]], 0)
    best = sums.argmax(1)
    share = sums.max(1) / np.maximum(sums.sum(1), 1e-12)
    named = [field.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist())]
    return named, np.where(letters, np.minimum(share, 1.0), 0.0)


def word_labels(text: str, field: Field) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and marginal."""
    w = split_words(pa.array([text], pa.large_string()))
    if len(w.hash) == 0:
        return []
    post, _ = forward_backward(field.scores(w), w.off, field.move)
    raw = w.data.tobytes()
    return [(raw[a:b].decode("utf-8", "replace"), field.langs[int(p.argmax())], float(p.max())) for a, b, p in zip(w.start, w.end, post)]


def train(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    training = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held).select("doc_id", "text", "lang")
    langs = sorted(r["lang"] for r in training.select("lang").distinct().collect())
    if not langs:
        return None
    lex = lexicon(training, langs)
    # each text gives a bounded run of words from a hashed place
    words = F.split(F.trim("text"), r"[\x20\x09-\x0D]+")
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size(words) - SAMPLE_WORDS, F.lit(1))).cast("int") + 1
    some = []
    for a in range(0, len(langs), LANGS_AT_ONCE):
        ids, part = None, langs[a : a + LANGS_AT_ONCE]
        for x in part:
            least = training.where(F.col("lang") == x).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            ids = least if ids is None else ids.unionAll(least)
        found = training.where(F.col("lang").isin(part)).join(F.broadcast(ids.distinct()), "doc_id")
        some += found.select("doc_id", "lang", F.array_join(F.slice(words, start, SAMPLE_WORDS), " ").alias("text")).collect()
    number = {x: i for i, x in enumerate(langs)}
    texts = [(r["text"], number[r["lang"]]) for r in sorted(some, key=lambda r: (r["doc_id"], r["lang"], r["text"]))]
    return fit(texts, langs, lex, max(SEQUENCES, LANG_SEQUENCES * len(langs)))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    tv.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    field = train(docs, sample)
    most = CHUNK * 16 // max(16, len(field.langs) if field else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches, most=most):
            named, score = label_rows(b.column(2), field)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, SCHEMA)
