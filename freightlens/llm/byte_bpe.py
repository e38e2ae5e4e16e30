"""Byte-level BPE encoding and decoding without a regex.

Pre-tokenisation works on whole columns.  Every code point gets a class (letter, number,
white space, other), and with its neighbours to the right one of eight symbols.  A symbol is
a function from the scanner's state to its next one.  Such functions compose, and the
composition is associative, so the states before all characters come from a scan over
composed functions: inside blocks side by side, then over the blocks' totals.  The scanner
is a finite one, so all compositions are numbered beforehand and composing is one table
look-up.  A boundary lies where state and symbol say so.

The slices between boundaries are merged pair by pair, the lowest rank first and of equal ones the
leftmost; slices met before are taken from a cache.  Each token keeps its byte offset in the
text; decoding joins the tokens' bytes.

The classes are those of the regex engine that the ranks' own library uses: each worker asks
it once which code points are letters, numbers and white space.

Defined cases: a null or empty text has no tokens and decodes to empty bytes; rows with equal or
null doc_id are encoded each by itself; an empty table gives an empty result; columns besides
doc_id and text are not read.  Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from freightlens.llm import textvec as tv
from freightlens.llm.runcache import RunCache, offsets, run_sums, take_runs

OTHER, LETTER, NUMBER, BLANK = range(4)
CACHE_SLICES = 1_000_000
#: Slices of more bytes are merged by a heap, one by one, and not kept.
LONG = 64
BLOCK = 256
SCHEMA = "doc_id long, ids array<int>, starts array<int>"

# --- classes and the scanner


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the byte each begins at."""
    if len(data) == 0 or int(data.max()) < 0x80:
        return data.astype(np.uint32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(data)))
    cp = data[at].astype(np.uint32)
    for n, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        few = np.flatnonzero(size == n)
        c = cp[few] & mask
        for k in range(1, n):
            c = c << 6 | data[at[few] + k] & 0x3F
        cp[few] = c
    return np.minimum(cp, 0x10FFFF), at


# States: what lies to the left of a character.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
# Symbols: a letter, number, other; an apostrophe with one or two letters of a contraction
# after it; white space with none or more white space after it, a space before something
# else, other white space before something else.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK, S_SPACE, S_LAST = range(8)


def _scanner() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether a slice begins, by state and symbol."""
    to = np.zeros((8, 8), np.uint8)
    cut = np.ones((8, 8), bool)
    to[:, S_LETTER], to[:, S_NUMBER], to[:, S_OTHER] = IN_LETTERS, IN_NUMBERS, IN_OTHERS
    to[:, S_SHORT], to[:, S_LONG] = ONE_MORE, TWO_MORE
    to[:, S_BLANK], to[:, S_SPACE], to[:, S_LAST] = IN_BLANKS, AFTER_SPACE, FRESH
    to[[IN_OTHERS, AFTER_SPACE], S_SHORT] = to[[IN_OTHERS, AFTER_SPACE], S_LONG] = IN_OTHERS
    to[ONE_MORE, S_LETTER], to[TWO_MORE, S_LETTER] = FRESH, ONE_MORE
    cut[[IN_LETTERS, AFTER_SPACE, ONE_MORE, TWO_MORE], S_LETTER] = False
    cut[[IN_NUMBERS, AFTER_SPACE], S_NUMBER] = False
    for s in (S_OTHER, S_SHORT, S_LONG):
        cut[[IN_OTHERS, AFTER_SPACE], s] = False
    cut[IN_BLANKS, S_BLANK] = False
    return to, cut


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, ...]:
    """All functions that compositions of symbols give, numbered.

    Symbol s is function s; s + 8 is the same at a row's beginning, where the state counts
    as FRESH whatever was before.  Returns the composition of each two, and each one's value by state.
    """
    to, cut = _scanner()
    known = [tuple(to[:, s].tolist()) for s in range(8)] + [(int(to[FRESH, s]),) * 8 for s in range(8)]
    number: dict[tuple, int] = {}
    for i, f in enumerate(known):
        number.setdefault(f, i)
    done = 0
    while done < len(known):
        f = known[done]
        for i in range(done + 1):
            for a, b in ((f, known[i]), (known[i], f)):
                both = tuple(b[x] for x in a)
                if both not in number:
                    number[both] = len(known)
                    known.append(both)
        done += 1
    table = np.zeros((len(known), len(known)), np.uint8)
    for i, a in enumerate(known):
        for j, b in enumerate(known):
            table[i, j] = number[tuple(b[x] for x in a)]
    return table.ravel(), np.array(known, np.uint8).ravel(), np.concatenate((cut, np.ones((8, 8), bool)), axis=1).ravel()


def _scan(f: np.ndarray) -> np.ndarray:
    """The state before each of the characters whose functions are ``f``."""
    compose, value, _ = _functions()
    m = len(value) // 8
    if len(f) <= BLOCK:
        out, state = np.empty(len(f), np.uint8), FRESH
        steps = value.reshape(-1, 8).tolist()
        for i, x in enumerate(f.tolist()):
            out[i] = state
            state = steps[x][state]
        return out
    blocks = -(-len(f) // BLOCK)
    x = np.zeros(blocks * BLOCK, np.uint8)
    x[: len(f)] = f
    x = np.ascontiguousarray(x.reshape(blocks, BLOCK).T)
    for j in range(1, BLOCK):
        x[j] = compose[x[j - 1].astype(np.uint16) * np.uint16(m) + x[j]]
    enter = _scan(x[-1])
    out = np.empty((BLOCK, blocks), np.uint8)
    out[0] = enter
    out[1:] = value[x[:-1].astype(np.uint16) * np.uint16(8) + enter]
    return out.T.ravel()[: len(f)]


def boundaries(data: np.ndarray, row_off: np.ndarray) -> np.ndarray:
    """The bytes at which slices begin, in rows of UTF-8 bytes laid end to end."""
    cp, at = code_points(data)
    if len(cp) == 0:
        return np.zeros(0, np.int64)
    none = np.uint32(0xFFFFFFFF)
    first = np.searchsorted(at, row_off[:-1][np.diff(row_off) > 0])
    next1 = np.append(cp[1:], none)
    next1[first[1:] - 1] = none
    next2 = np.append(next1[1:], none)
    kind = classes()[cp]
    blank = kind == BLANK
    next_blank = np.append(blank[1:], True) | (next1 == none)
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_BLANK], np.uint8)[kind]
    symbol[blank & ~next_blank] = S_LAST
    symbol[(cp == 0x20) & ~next_blank] = S_SPACE
    quote = np.flatnonzero(cp == 0x27)
    a, b = next1[quote], next2[quote]
    symbol[quote[np.isin(a, [ord(c) for c in "stmd"])]] = S_SHORT
    two = np.zeros(len(quote), bool)
    for x, y in ("re", "ve", "ll"):
        two |= (a == ord(x)) & (b == ord(y))
    symbol[quote[two]] = S_LONG
    symbol[first] += 8
    state = _scan(symbol)
    return at[_functions()[2][state.astype(np.uint16) * np.uint16(16) + symbol]]


# --- merging


class Vocabulary:
    """Ranks of a byte-level BPE: token bytes, and the rank of each mergeable pair of tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        self.token = [b""] * size
        for t, i in self.rank.items():
            self.token[i] = t
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.start = offsets(self.size)[:-1]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.pair = {}
        for t, i in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = i
        self.index = tv.HashIndex()
        self.index.add(tv.mix(np.fromiter(self.pair, np.uint64, len(self.pair))))
        self.pair_rank = np.append(np.fromiter(self.pair.values(), np.int64, len(self.pair)), NEVER)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NEVER for one that doesn't merge."""
        return self.pair_rank[self.index.find(tv.mix((a << 32 | b).astype(np.uint64)))]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these tokens end to end."""
        return take_runs(self.bytes, self.start[ids], self.size[ids])


NEVER = np.int64(1) << 40


def merge_all(vocab: Vocabulary, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge slices laid end to end, one pair of each in every round; ids and their numbers by slice."""
    ids = vocab.byte[data]
    own = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.full(len(ids), NEVER)
    inner = np.flatnonzero(own[1:] == own[:-1])
    rank[inner] = vocab.ranks(ids[inner], ids[inner + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(ids):
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        run = np.diff(np.append(first, len(own)))
        best = np.minimum.reduceat(rank, first)
        over = np.repeat(best == NEVER, run)
        if over.any():
            done.append((own[over], ids[over]))
            go = ~over
            ids, own, rank, best, run = ids[go], own[go], rank[go], best[best < NEVER], run[best < NEVER]
            if len(ids) == 0:
                break
        hit = np.flatnonzero(rank == np.repeat(best, run))
        hit = hit[np.append(True, own[hit[1:]] != own[hit[:-1]])]
        ids[hit] = rank[hit]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))
        ids, own, rank = ids[keep], own[keep], rank[keep]
        for left in (at, at[at > 0] - 1):
            rank[left] = NEVER
            left = left[left + 1 < len(ids)]
            left = left[own[left] == own[left + 1]]
            rank[left] = vocab.ranks(ids[left], ids[left + 1])
    own = np.concatenate([o for o, _ in done] or [np.zeros(0, np.int64)])
    ids = np.concatenate([i for _, i in done] or [np.zeros(0, np.int64)])
    return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(sizes))


def merge_one(vocab: Vocabulary, piece: bytes) -> list[int]:
    """Merge one slice; a heap of pairs keeps long ones near linear."""
    ids = [vocab.rank[bytes([b])] for b in piece]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(ids) and (r := vocab.pair.get(ids[i] << 32 | ids[j])) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    for i in range(len(ids)):
        offer(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[j] < len(ids):
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [x for x in ids if x >= 0]


class Encoder:
    """Ids and byte offsets of whole columns; slices met before come from the cache."""

    def __init__(self, path: str, keep: int = CACHE_SLICES):
        self.vocab = Vocabulary(path)
        self.cache = RunCache({"ids": np.int32}, keep)

    def _merged(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        whole = [self.vocab.rank.get(raw[a : a + n], -1) for a, n in zip(start.tolist(), size.tolist())]
        whole = np.array(whole, np.int64)
        count = np.ones(len(start), np.int64)
        open_ = np.flatnonzero((whole < 0) & (size <= LONG))
        ids, count[open_] = merge_all(self.vocab, take_runs(data, start[open_], size[open_]), size[open_])
        long = [(i, merge_one(self.vocab, raw[start[i] : start[i] + size[i]])) for i in np.flatnonzero((whole < 0) & (size > LONG)).tolist()]
        for i, x in long:
            count[i] = len(x)
        off = offsets(count)
        out = np.empty(off[-1], np.int64)
        out[off[:-1][whole >= 0]] = whole[whole >= 0]
        out[np.repeat(off[:-1][open_] - offsets(count[open_])[:-1], count[open_]) + np.arange(len(ids))] = ids
        for i, x in long:
            out[off[i] : off[i + 1]] = x
        return out, count

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, the byte of its own text at which each begins, the n+1 offsets of the rows."""
        data, row_off = tv.text_buffer(col)
        start = boundaries(data, row_off)
        if len(start) == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(row_off), np.int64)
        until = np.append(start[1:], len(data))
        size = until - start
        # A long slice is a key of its own in this column alone.
        short = size <= LONG
        ids, count = np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        key = tv.span_hash(data, tv._BYTE_ALL, start, until)
        few = np.flatnonzero(short)
        at = self.cache.places(key[few], lambda new: {"ids": self._merged(data, start[few[new]], size[few[new]])})
        ids, count[few] = self.cache.run("ids", at)
        if len(few) < len(start):
            rest = np.flatnonzero(~short)
            more, count[rest] = self._merged(data, start[rest], size[rest])
            own = np.concatenate((np.repeat(few, count[few]), np.repeat(rest, count[rest])))
            ids = np.concatenate((ids, more.astype(np.int32)))[np.argsort(own, kind="stable")]
        off = offsets(count)[np.searchsorted(start, row_off)]
        begin = offsets(self.vocab.size[ids])[:-1] - np.repeat(row_off[:-1], np.diff(off))
        return ids, begin, off


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


# --- operators


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, the token ids of the whole text, and the byte each token starts at in the text's UTF-8."""
    tv.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for b in tv.slices(batches):
            ids, begin, off = enc.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids, off), _lists(begin, off)], names=["doc_id", "ids", "starts"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def _runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end and the n+1 offsets; a null list is empty."""
    return col.flatten().to_numpy(zero_copy_only=False), offsets(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the bytes of its ids; bytes, since ids cut anywhere need not be UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = encoder(ranks).vocab
        for b in batches:
            ids, off = _runs(b.column(1))
            raw, ends = vocab.joined(ids).tobytes(), offsets(run_sums(vocab.size[ids], off))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[x:y] for x, y in zip(ends[:-1], ends[1:])], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(encoded: DataFrame, ranks: str) -> DataFrame:
    """n_tokens, and the SHA-256 of the ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = encoder(ranks).vocab
        for b in batches:
            ids, off = _runs(b.column(1))
            raw, ends = vocab.joined(ids), offsets(run_sums(vocab.size[ids], off))
            wide = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array([sha256(wide[x:y]).hexdigest() for x, y in zip(off[:-1], off[1:])], pa.string()),
                    pa.array([sha256(raw[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:])], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
