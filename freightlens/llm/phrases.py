"""Phrase collocations by Toivonen's sampling.

A phrase is one to four consecutive words of a piece of a text.  A sample of the documents
proposes phrases that are frequent in it at a lowered threshold.  A pass over all documents
counts the proposed phrases and their negative border exactly: every phrase whose beginning and end, each one
word shorter, are proposed (a single word always is).  A phrase of the border that turns out
frequent is a failure of the sample: it joins the proposed ones, and another pass
counts the phrases that are now within the border and were not counted before.  When a pass has no
failures, every frequent phrase has been counted, since all its parts are frequent too.  That takes
four passes at most.

Phrases are keys of 62 bits (over the bytes of their words and the language), with their length in
the two lowest bits.  Proposed phrases are sent to the tasks as a bitmap of fixed size over
keys; a chance hit in it only makes more phrases be counted, so results don't depend on it.  Counts
carry one of ``SHARDS`` numbers of a document that has the phrase, so that the last pass,
which looks up the words of frequent phrases, reports each from a few documents.

Defined cases: null text is empty, null lang ``und``; a language without candidates has no rows; rows
with equal or null doc_id all count; ties in score and count go by the phrase's bytes; an
empty table gives an empty result; columns besides doc_id, text and lang are not read.
Counts cover all documents; the sample only proposes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightlens.llm import textvec as tv
from freightlens.llm.shared import table

LONGEST = 4
SHARDS = 4096
#: One document in so many is in the sample, by hash.
SAMPLE = 8
BITMAP_BITS = 26
CHUNK_BYTES = 8 << 20

_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?"]] = _SPLIT[10:14] = True
_GAP = _SPLIT.copy()
_GAP[[0x20, 0x09]] = True
_WEIGHT = tv._BYTE_ALL.copy()
_WEIGHT[_GAP] = 0
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_LENGTH = np.uint64(3)


class Phrases:
    """The words of a run of rows, and the keys of the phrases that begin at each."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        data, row_off = tv.text_buffer(text)
        self.data = tv._LOWER[data]
        n = len(data)
        gap = np.ones(n + 1, bool)
        gap[:n] = _GAP[self.data]
        first = np.zeros(n + 1, bool)
        first[row_off] = True
        before = np.append(True, gap[:-1]) | first
        self.start = np.flatnonzero(before[:n] & ~gap[:n])
        self.end = np.flatnonzero((gap[1:] | first[1:]) & ~gap[:n]) + 1
        self.row = np.searchsorted(row_off, self.start, side="right") - 1
        self.piece = self.row + np.searchsorted(np.flatnonzero(_SPLIT[self.data]), self.start)
        code, seed = self._languages(lang)
        self.seed = seed
        self.lang = code[self.row]
        # Gaps weigh nothing, so a word and the gap after it hash as the word.
        if len(self.start):
            body = self.data[self.start[0] :]
            long = int((self.end - self.start).max())
            rel = np.arange(len(body)) - np.repeat(self.start - self.start[0], np.diff(np.append(self.start, n)))
            sums = np.add.reduceat(_WEIGHT[body] * tv._powers(long + 1)[np.minimum(rel, long)], self.start - self.start[0])
            self.word = tv.mix(sums ^ (self.end - self.start).astype(np.uint64))
        else:
            self.word = np.zeros(0, np.uint64)

    def _languages(self, lang: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes = lang.dictionary_encode()
        self.names = codes.dictionary.to_pylist()
        data, off = tv.text_buffer(codes.dictionary)
        full = np.flatnonzero(np.diff(off))
        seed = np.zeros(len(self.names), np.uint64)
        seed[full] = tv.span_hash(data, tv._BYTE_ALL, off[full], off[full + 1])
        return codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), tv.mix(seed + _STEP)

    def keys(self, at: np.ndarray, length: int, shorter: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the phrases of this length at these words; ``shorter``: those of one word less."""
        h = self.seed[self.lang[at]] if shorter is None else shorter
        return tv.mix(h * _STEP + self.word[at + length - 1])

    def levels(self, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, words, keys) of the phrases to look at.

        ``wanted(length, keys)`` says which phrases of a length count as proposed; of longer ones
        only those come whose beginning and end are.
        """
        at = np.arange(len(self.start))
        hashes = self.keys(at, 1)
        for length in range(1, LONGEST + 1):
            key = named(hashes, length)
            yield length, at, key
            if length == LONGEST:
                return
            inside = wanted(length, key)
            at, hashes = at[inside], hashes[inside]
            # A phrase of one word more begins here and ends with the proposed one at the next word.
            go = np.zeros(len(at), bool)
            go[:-1] = at[1:] == at[:-1] + 1
            go &= self.piece[np.minimum(at + length, len(self.piece) - 1)] == self.piece[at]
            go &= at + length < len(self.piece)
            hashes = self.keys(at[go], length + 1, hashes[go])
            at = at[go]

    def text(self, at: np.ndarray, length: int) -> list[str]:
        raw = self.data.tobytes()
        return [b" ".join(raw[self.start[w] : self.end[w]] for w in range(i, i + length)).decode("utf-8", "replace") for i in at.tolist()]


def named(hashes: np.ndarray, length: int) -> np.ndarray:
    return (hashes & ~_LENGTH) | np.uint64(length - 1)


def total_keys(seed: np.ndarray) -> np.ndarray:
    """The keys under which all words of a language are counted."""
    return named(tv.mix(seed ^ _STEP), 1)


# --- bitmaps of keys


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bit ``key >> (64 - bits)`` of each key; collected by 64-bit words, 2^(bits - 6) rows at most."""
    places = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
    rows = places.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("one"))
    got = rows.groupBy("word").agg(F.expr("bit_or(one)").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys' bits are set."""
    place = keys >> np.uint64(64 - 6 - int(np.log2(len(bits))))
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


# --- passes


def _rows(docs: DataFrame) -> DataFrame:
    tv.bounded_batches(docs.sparkSession)
    both = F.xxhash64("doc_id", "text", F.lit("shard"))
    return docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), F.pmod(both, F.lit(SHARDS)).cast("int").alias("shard"))


def _counted(keys: list[np.ndarray], shards: list[np.ndarray]) -> pa.RecordBatch:
    """Equal keys become one, with their number and the shard of one of them."""
    key, shard = np.concatenate(keys), np.concatenate(shards)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(n, pa.int64()), pa.array(shard[order][first], pa.int32())], names=["key", "n", "shard"])


def _count(rows: DataFrame, old: np.ndarray | None, new: np.ndarray | None) -> DataFrame:
    """key, n, shard of the phrases whose parts are in ``new`` (all, if None) and not within the border of ``old``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches, most=CHUNK_BYTES):
            p = Phrases(b.column(0), b.column(1))
            shard = b.column(2).to_numpy()
            keys, shards = [], []
            before: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.int64), np.zeros(0, bool)
            for length, at, key in p.levels(lambda n, k: np.ones(len(k), bool) if new is None else held(new, k)):
                fresh = np.full(len(at), old is None)
                if old is not None:
                    # Counted before: all words, and phrases whose beginning and end were counted and proposed.
                    if length > 1:
                        begin, end = np.searchsorted(before[0], at), np.searchsorted(before[0], at + 1)
                        fresh = ~(before[1][begin] & before[1][end])
                    before = at, ~fresh & held(old, key)
                keys.append(key[fresh])
                shards.append(shard[p.row[at[fresh]]])
            yield _counted(keys, shards)
            if old is None:
                words = np.bincount(p.lang, minlength=len(p.seed))
                yield pa.RecordBatch.from_arrays([pa.array(total_keys(p.seed).view(np.int64)), pa.array(words, pa.int64()), pa.array(np.zeros(len(words)), pa.int32())], names=["key", "n", "shard"])

    return rows.mapInArrow(run, "key long, n long, shard int").groupBy("key").agg(F.sum("n").alias("n"), F.min("shard").alias("shard"))


def frequent_phrases(docs: DataFrame, least: int = 30, sample: int = SAMPLE) -> DataFrame:
    """key, n and shard of all phrases of 1 to 4 words with n >= least, and of all words of a language as one."""
    rows = _rows(docs)
    part = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0)
    low = max(2, int(0.6 * least / sample))
    proposed = bitmap(_count(_rows(part), None, None).filter(F.col("n") >= low).select("key"))
    old: np.ndarray | None = None
    found: DataFrame | None = None
    while True:
        passed = table(_count(rows, old, proposed).filter(F.col("n") >= least), "phrase-counts")
        found = passed if found is None else found.unionAll(passed)
        failed = bitmap(passed.filter(F.col("key").bitwiseAND(3) < LONGEST - 1).select("key")) & ~proposed
        if not failed.any():
            return found
        old, proposed = proposed, proposed | failed


def _named_phrases(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, lang, phrase, total (key of its language's words), cuts and parts of the frequent phrases of two words or more.

    ``cuts``: keys of (first k words, rest) by k; ``parts``: keys of the phrases of two words or more within.
    """
    known = bitmap(found.select("key"))
    owner = bitmap(found.select(_owner_key().alias("key")))
    schema = "key long, lang string, phrase string, total long, cuts array<struct<k:int,left:bigint,right:bigint>>, parts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches, most=CHUNK_BYTES):
            p = Phrases(b.column(0), b.column(1))
            shard = b.column(2).to_numpy().astype(np.uint64)
            out: dict[str, list] = {f: [] for f in ("key", "lang", "phrase", "total", "cuts", "parts")}
            keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            totals = total_keys(p.seed).view(np.int64)
            for length, at, key in p.levels(lambda n, k: held(known, k)):
                keys[length] = at, key.view(np.int64)
                if length == 1:
                    continue
                ours = np.flatnonzero(held(known, key) & held(owner, owned(key, shard[p.row[at]])))
                ours = ours[np.unique(key[ours], return_index=True)[1]]
                words = at[ours]

                def part(k: int, skip: int) -> np.ndarray:
                    return keys[k][1][np.searchsorted(keys[k][0], words + skip)]

                cuts = [list(zip(part(k, 0).tolist(), part(length - k, k).tolist())) for k in range(1, length)]
                parts = [part(k, skip).tolist() for k in range(2, length) for skip in range(length - k + 1)]
                out["key"] += key[ours].view(np.int64).tolist()
                out["lang"] += [p.names[i] for i in p.lang[words].tolist()]
                out["phrase"] += p.text(words, length)
                out["total"] += totals[p.lang[words]].tolist()
                out["cuts"] += [[{"k": k + 1, "left": c[i][0], "right": c[i][1]} for k, c in enumerate(cuts)] for i in range(len(words))]
                out["parts"] += [[x[i] for x in parts] for i in range(len(words))]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("k", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(out[f], t) for f, t in zip(out, types)], names=list(out))

    firsts = [F.any_value(c).alias(c) for c in ("lang", "phrase", "total", "cuts", "parts")]
    return rows.mapInArrow(run, schema).groupBy("key").agg(*firsts).join(found, "key")


def _owner_key():
    """The key with its owner's shard mixed into the bits a bitmap reads."""
    return F.expr("key ^ shiftleft(cast(shard as bigint), 52)")


def owned(key: np.ndarray, shard: np.ndarray) -> np.ndarray:
    return key ^ (shard << np.uint64(52))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to four words of each language.

    a is the phrase's count, l and r those of its parts at its worst cut, n all words of the language; score is
    ``floor(2000000 a / (l + r))``.  Phrases within a longer one that has 80 % of their count are left out.
    """
    found = frequent_phrases(docs, least, sample)
    named_ = table(_named_phrases(_rows(docs), found).select("key", "lang", "phrase", "total", "cuts", "parts", F.col("n").alias("a")), "phrases")
    count = found.select(F.col("key"), F.col("n"))
    cuts = named_.select("key", "a", F.explode("cuts").alias("c")).select("key", "a", "c.*")
    cuts = cuts.join(count.select(F.col("key").alias("left"), F.col("n").alias("l")), "left").join(count.select(F.col("key").alias("right"), F.col("n").alias("r")), "right")
    score = F.expr("cast((cast(a as decimal(28, 0)) * 2000000) div (cast(l as decimal(28, 0)) + r) as bigint)").alias("score")
    worst = cuts.select("key", "k", "l", "r", score).groupBy("key").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("w")).select("key", "w.*")
    longer = named_.select("a", F.explode("parts").alias("key")).groupBy("key").agg(F.max("a").alias("longer"))
    kept = named_.join(longer, "key", "left").filter(F.col("longer").isNull() | (5 * F.col("longer") < 4 * F.col("a"))).join(worst, "key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may hold most phrases: the best of each of 64 parts first.
    best = kept.withColumn("salt", F.pmod(F.hash("key"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = count.select(F.col("key").alias("total"), F.col("n"))
    return best.join(totals, "total").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
