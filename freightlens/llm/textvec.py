"""Vectorised word splitting and hashing over Arrow text columns.

Words are runs of bytes other than space and 0x09-0x0D, which in UTF-8 equals
the code-point pattern ``[^\\x20\\x09-\\x0D]+``.  Work is done on the column's
byte buffer, a few megabytes at a time, so a task's memory does not follow the
size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
ARROW_ROWS = 1000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WS] = 0
_MARK = ~(_LETTER | _WS)
_MARK[128:] = False
_BYTE_ALL = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        p = np.full(max(n, 1024), _R, np.uint64)
        p[0] = 1
        _POW = np.multiply.accumulate(p)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix): spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounded_batches(spark) -> None:
    """Keep Arrow batches small: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.large_string():
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds at most ``most`` text bytes, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        _, off = text_buffer(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a run of rows: byte spans, hashes and the first word of each row."""

    data: np.ndarray
    row_off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray  # n_rows + 1 positions in start / end / hash

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def span_hash(data: np.ndarray, table: np.ndarray, start: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, until); the spans ascend and don't overlap."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    lengths = until - start
    if int(lengths.sum()) == len(data) - int(start[0]) and until[-1] == len(data):
        body = data[start[0] :]
    else:
        keep = np.zeros(len(data) + 1, np.int8)
        np.add.at(keep, start, 1)
        np.add.at(keep, until, -1)
        body = data[np.cumsum(keep[:-1]).astype(bool)]
    first = np.cumsum(lengths) - lengths
    rel = np.arange(len(body), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    v = table[body]
    v *= _powers(int(lengths.max()) + 1)[rel]
    h = np.add.reduceat(v, first)
    return mix(h ^ (lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def split_words(col: pa.Array, lower: bool = True) -> Words:
    data, row_off = text_buffer(col)
    if lower:
        data = _LOWER[data]
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, row_off, z, z, np.zeros(0, np.uint64), np.zeros(len(row_off), np.int64))
    ws = _WS[data]
    first = np.zeros(n + 1, bool)
    first[row_off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ws[:-1]
    before |= first[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ws[1:]
    after |= first[1:]
    start = np.flatnonzero(before & ~ws)
    end = np.flatnonzero(after & ~ws) + 1
    del before, after, first
    until = np.append(start[1:], n) if len(start) else start
    h = _word_hash(data, start, until, end)
    return Words(data, row_off, start, end, h, np.searchsorted(start, row_off))


def _word_hash(data: np.ndarray, start: np.ndarray, until: np.ndarray, end: np.ndarray) -> np.ndarray:
    """White space weighs nothing, so a word and the space up to the next hash as the word."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    body = data[start[0] :]
    rel = np.arange(len(body), dtype=np.int32) - np.repeat((start - start[0]).astype(np.int32), until - start)
    longest = int((end - start).max())
    np.minimum(rel, longest, out=rel)
    v = _BYTE[body]
    v *= _powers(longest + 1)[rel]
    h = np.add.reduceat(v, start - start[0])
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def split_units(col: pa.Array) -> Words:
    """Words with the white space before them, cut where an ASCII letter meets a mark.

    White space at a row's end is a unit too: units tile every row.  Case is kept.
    """
    data, row_off = text_buffer(col)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(data, row_off, z, z, np.zeros(0, np.uint64), np.zeros(len(row_off), np.int64))
    ws = _WS[data]
    starts = np.zeros(n, bool)
    starts[1:] = (ws[1:] & ~ws[:-1]) | (_LETTER[data[:-1]] & _MARK[data[1:]])
    starts[row_off[:-1][row_off[:-1] < n]] = True
    start = np.flatnonzero(starts)
    until = np.append(start[1:], n)
    return Words(data, row_off, start, until, span_hash(data, _BYTE_ALL, start, until), np.searchsorted(start, row_off))


class HashIndex:
    """Positions of 64-bit keys in the order they were added; vectorised open addressing."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.key = np.zeros(1 << bits, np.uint64)
        self.val = np.full(1 << bits, -1, np.int32)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if absent."""
        slot, mask = self._home(h), (1 << self.bits) - 1
        out = self.val[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            v = self.val[slot]
            out[todo] = v
            more = (v >= 0) & (self.key[slot] != h[todo])
            todo, slot = todo[more], slot[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Add distinct keys that are absent."""
        if (self.n + len(h)) * 2 > len(self.key):
            old, order = self.key[self.val >= 0], np.argsort(self.val[self.val >= 0])
            while (self.n + len(h)) * 2 > 1 << self.bits:
                self.bits += 1
            self.key, self.val = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(old[order], 0)
        self._put(h, self.n)
        self.n += len(h)

    def _put(self, h: np.ndarray, at: int) -> None:
        slot, mask = self._home(h), (1 << self.bits) - 1
        v = np.arange(at, at + len(h), dtype=np.int32)
        while len(h):
            free = self.val[slot] < 0
            self.val[slot[free]] = v[free]
            won = free & (self.val[slot] == v)
            self.key[slot[won]] = h[won]
            h, v, slot = h[~won], v[~won], (slot[~won] + 1) & mask


def per_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs values[off[i]:off[i+1]]; empty runs give 0."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return c[off[1:]] - c[off[:-1]]
