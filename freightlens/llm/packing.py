"""Cost-balanced packing of tokenised documents into sequences.

A document costs ``linear * n + quadratic * n^2`` (feed-forward plus attention).
Each task packs the documents it reads, a bounded window at a time: whole
sequences are cut off long documents first, the rest go, longest first, to the
cheapest sequence that still has room.  A window's sequences have room for exactly
its tokens: full ones, and for what is left the powers of two that make it up,
which need no padding.  No rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freightlens.llm import textvec as tv

MAX_TOKENS = 1024
WINDOW_TOKENS = 2_000_000
CACHE_UNITS = 1_500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


#: Fixed value: the public pre-tokenisation pattern of the byte-level BPE.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bpe(tok):
    """The tokenizer's own vocabulary in a faster BPE, if it is plain byte-level BPE."""
    import json

    import tiktoken

    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = set(t.content for t in tok.get_added_tokens_decoder().values())
    ranks = {bytes(char[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class UnitEncoder:
    """Token ids of whole columns; equal to encoding each text by itself.

    The byte-level pre-tokeniser never joins a non-space character with white
    space after it, nor a letter with a mark after it, so units (white space and
    the word or marks after it) are encoded apart and their ids kept.  Rows with
    other Unicode spaces or the name of a special token are encoded whole.
    """

    def __init__(self, path: str, keep: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.bpe = _bpe(self.tok) or (lambda text: self.tok.encode(text, add_special_tokens=False).ids)
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.index = tv.HashIndex()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 14, np.int64)

    def _add(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = [self.bpe(x) for x in texts]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
        n = self.index.n
        at = int(self.off[n])
        while at + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while n + len(got) + 1 > len(self.off):
            self.off = np.concatenate((self.off, np.zeros_like(self.off)))
        self.ids[at : at + len(flat)] = flat
        self.off[n + 1 : n + 1 + len(got)] = at + np.cumsum(sizes)
        self.index.add(hashes)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the n+1 offsets of the rows."""
        u = tv.split_units(col)
        rows = len(u.row_off) - 1
        if len(u.start) == 0:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        at = self.index.find(u.hash)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if self.index.n + len(miss) > self.keep:
                self._clear()
                miss = np.arange(len(u.hash))
            uniq, first = np.unique(u.hash[miss], return_index=True)
            raw = u.data.tobytes()
            self._add(uniq, [raw[u.start[j] : u.end[j]].decode("utf-8", "replace") for j in miss[first].tolist()])
            at[miss] = self.index.find(u.hash[miss])
        size = self.off[at + 1] - self.off[at]
        total = np.concatenate(([0], np.cumsum(size)))
        pos = np.arange(total[-1]) - np.repeat(total[:-1] - self.off[at], size)
        ids, off = self.ids[pos], total[u.off]
        odd = self._whole_rows(u)
        if len(odd):
            parts = [ids[off[i] : off[i + 1]] for i in range(rows)]
            for i in odd.tolist():
                text = u.data[u.row_off[i] : u.row_off[i + 1]].tobytes().decode("utf-8", "replace")
                parts[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, off

    def _whole_rows(self, u: tv.Words) -> np.ndarray:
        d = u.data
        hit = (d >= 0x1C) & (d <= 0x1F)
        a, b = d[:-1], d[1:]
        hit[:-1] |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        if len(d) > 2:
            c = d[2:]
            three = (a[:-1] == 0xE1) & (b[:-1] == 0x9A) & (c == 0x80)
            three |= (a[:-1] == 0xE2) & (b[:-1] == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            three |= (a[:-1] == 0xE2) & (b[:-1] == 0x81) & (c == 0x9F)
            three |= (a[:-1] == 0xE3) & (b[:-1] == 0x80) & (c == 0x80)
            hit[:-2] |= three
        found = np.flatnonzero(hit)
        raw = d.tobytes()
        for s in self.special:
            key, at = s.encode(), -1
            more = []
            while (at := raw.find(key, at + 1)) >= 0:
                more.append(at)
            found = np.concatenate((found, np.array(more, np.int64)))
        return np.unique(np.searchsorted(u.row_off, found, side="right") - 1)


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def room(total: int, size: int = MAX_TOKENS) -> np.ndarray:
    """Sequence sizes that hold exactly ``total`` tokens: full ones and powers of two."""
    rest = total % size
    return np.array([size] * (total // size) + [1 << b for b in range(size.bit_length(), -1, -1) if rest >> b & 1], np.int64)


def assign(lengths: np.ndarray, size: int = MAX_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths.

    Longest remainder first, ties by position; each goes to the sequence of least
    cost that has room for all of it, or, if none has, as much of it as fits to the
    sequence of least cost with any room.
    """
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    for i, n in enumerate(lengths.tolist()):
        for at in range(0, n - n % size, size):
            out.append((i, at, size, seq, 0))
            seq += 1
    rest = lengths % size
    left = room(int(rest.sum()), size)
    used, cost = np.zeros(len(left), np.int64), np.zeros(len(left))
    for i in np.argsort(-rest, kind="stable").tolist():
        n, at = int(rest[i]), int(lengths[i] - rest[i])
        while n:
            fits = np.flatnonzero(left >= n)
            if len(fits) == 0:
                fits = np.flatnonzero(left > 0)
            j = int(fits[np.argmin(cost[fits])])
            take = min(n, int(left[j]))
            out.append((i, at, take, seq + j, int(used[j])))
            left[j] -= take
            used[j] += take
            cost[j] += linear * take + quadratic * take * take
            at, n = at + take, n - take
    cols = np.array(out, np.int64).reshape(-1, 5).T
    return tuple(cols)


def pack(docs: DataFrame, tokenizer: str, size: int = MAX_TOKENS, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row for each piece of a document, see ``SCHEMA``; cost is the piece's own.

    ``docs`` needs doc_id and text; other columns are left out.  A null or empty
    text is the end token alone.  Rows with equal or null doc_id are packed apart.
    An empty table gives no rows.  Sequence ids are unique, not dense: the task's
    number and a count in it.
    """
    tv.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, seq = encoder(tokenizer), TaskContext.get().partitionId() << 36
        held: list[tuple[list, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            keys = [k for ks, _ in held for k in ks]
            docs_ids = [x for _, xs in held for x in xs]
            lengths = np.array([len(x) for x in docs_ids], np.int64)
            doc, start, length, s, offset = assign(lengths, size, linear, quadratic)
            crc = [zlib.crc32(docs_ids[d][a : a + n].astype("<u4").tobytes()) for d, a, n in zip(doc, start, length)]
            got = pa.RecordBatch.from_arrays(
                [pa.array([keys[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array(s + seq), pa.array(offset), pa.array(linear * length + quadratic * length.astype(float) ** 2)],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )
            seq += int(s.max()) + 1 if len(s) else 0
            held.clear()
            return got

        for b in tv.slices(batches):
            ids, off = enc.encode(b.column(1))
            held.append((b.column(0).to_pylist(), [np.append(ids[x:y], np.uint32(end_id)) for x, y in zip(off[:-1], off[1:])]))
            tokens += len(ids)
            if tokens >= WINDOW_TOKENS:
                yield flush()
                tokens = 0
        if held:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
