"""Alignment of two tokenizers' tokens on the same text, by interval coalescing.

Both tokenizers see a space and the text.  All A and B tokens are sorted by the byte they start
at (``lexsort``) with the running maximum of their ends (``maximum.accumulate``): a group ends
where the next start reaches that maximum, which is where tokens of both end.  Inside a group
the overlaps of A with B tokens are expanded; those that end together are the links.

Both tokenizers cut before a space that follows something other than white space, and neither joins
across, so a text falls into units (spaces and what follows them) that are aligned apart.
A unit met before comes from a cache; a text's groups are its units' groups end to end.  B's
vocabulary is looked through for a piece that would join across; if it had one, whole
texts would be the units.

``pair_counts`` counts, over all aligned texts, the links of each pair of ids.  ``weigh`` gives each
document the counts of its links.  The most frequent pairs, at most ``FREQUENT``, go to all
tasks; a document's other pairs are joined with their counts by shuffle, and each of those is rarer than
the frequent ones, so no key is hot.

Defined cases: texts that are null, empty, or that A's or B's tokens don't spell byte for byte have
no tokens: zeros, empty groups.  Rows with equal or null doc_id are aligned each by itself
and all count.  Ties of a B id's highest count all count as its best.  An empty table gives an
empty result.  Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightlens.llm import textvec as tv
from freightlens.llm.byte_bpe import _lists, _runs
from freightlens.llm.runcache import RunCache, offsets, run_sums, take_runs
from freightlens.llm.shared import table

CACHE_UNITS = 400_000
#: Units of more bytes are aligned each time.
LONG = 256
BLOCK_BYTES = 4096
CHUNK_BYTES = 1 << 20
#: Pairs of ids whose counts every task holds: 17 bytes each.
FREQUENT = 1 << 18
SCHEMA = {"doc_id": "long", "n_a": "long", "n_b": "long", "n_groups": "long", "groups": "string", "group_ends": "array<int>", "links": "array<bigint>"}
#: Columns of ``align`` that may be left out, and the runs they are made of.
RUNS = {"groups": "text", "group_ends": "ends", "links": "links"}


# --- tokenizers


class Tokens:
    """Ids of strings, and the bytes of each id; ``add_space`` is what the tokenizer puts before a text itself."""

    def __init__(self, encode, token_bytes: list[bytes], splits: bool, add_space: bool):
        self.encode, self.splits, self.add_space = encode, splits, add_space
        self.size = np.array([len(b) for b in token_bytes], np.int64)
        self.start, self.flat = offsets(self.size)[:-1], np.frombuffer(b"".join(token_bytes), np.uint8)


def byte_level(path: str) -> Tokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = tok.get_vocab(with_added_tokens=False)
    spelt = [b""] * (max(tok.get_vocab().values()) + 1)
    for t, i in vocab.items():
        spelt[i] = bytes(char[c] for c in t) if all(c in char for c in t) else t.encode()
    return Tokens(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], spelt, True, False)


def sentence_piece(path: str) -> Tokens:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt, splits = [], True
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        splits &= "▁" not in piece.lstrip("▁")
        spelt.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    # A space at a text's end is a unit of its own, and nothing but what the tokenizer puts before it.
    space = [sp.piece_to_id("▁")]
    return Tokens(lambda texts: [ids if t else space for t, ids in zip(texts, sp.encode(texts, num_threads=1))], spelt, splits, True)


# --- units and groups


def with_space(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a space and the text for every row that has a text, and the n+1 row offsets."""
    data, off = tv.text_buffer(col)
    has = np.diff(off) > 0
    new = offsets(np.diff(off) + has)
    out = np.full(new[-1], 0x20, np.uint8)
    body = np.ones(new[-1], bool)
    body[new[:-1][has]] = False
    out[body] = data
    return out, new


def odd_space(data: np.ndarray) -> np.ndarray:
    """Where a character ends that some tokenizer may take for white space, or a control character."""
    odd = data <= 0x20
    if len(data) > 2:
        x, y, z = data[:-2], data[1:-1], data[2:]
        odd[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        three = (x == 0xE1) & (((y == 0x9A) & (z == 0x80)) | ((y == 0xA0) & (z == 0x8E)))
        three |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8F) | (z >= 0xA8) & (z <= 0xAF))) | (y == 0x81) & ((z == 0x9F) | (z == 0xA0)))
        three |= (x == 0xE3) & (y == 0x80) & (z == 0x80) | (x == 0xEF) & (y == 0xBB) & (z == 0xBF)
        odd[2:] |= three
    return odd


def unit_starts(data: np.ndarray, row_off: np.ndarray, splits: bool) -> np.ndarray:
    """Row starts, and spaces after something that no tokenizer takes for white space."""
    begin = np.zeros(len(data) + 1, bool)
    if splits and len(data) > 2:
        begin[1:-1] = (data[1:] == 0x20) & ~odd_space(data)[:-1]
    begin[row_off] = True
    return np.flatnonzero(begin[:-1])


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of intervals by start, and in that order the group each belongs to."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(fresh) - 1


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of A and B intervals that share a byte; each side ascends and doesn't overlap itself."""
    first = np.searchsorted(b_end, a_start, side="right")
    n = np.maximum(np.searchsorted(b_start, a_end, side="left") - first, 0)
    return np.repeat(np.arange(len(a_start)), n), np.arange(n.sum()) + np.repeat(first - offsets(n)[:-1], n)


class Aligner:
    """Groups and links of units, kept from column to column."""

    KINDS = {"text": np.uint8, "ends": np.int32, "links": np.int64, "counts": np.int32}

    def __init__(self, a: Tokens, b: Tokens, keep: int = CACHE_UNITS):
        self.a, self.b, self.splits = a, b, a.splits and b.splits
        # Every id in decimal, after a place for the mark before it.
        written = [f"?{i}".encode() for i in range(max(len(a.size), len(b.size)))]
        size = np.array([len(w) for w in written], np.int64)
        self.digits, self.decimal = np.frombuffer(b"".join(written), np.uint8), (offsets(size)[:-1], size)
        self.cache = RunCache(self.KINDS, keep)

    def _ids(self, tok: Tokens, text: bytes) -> np.ndarray | None:
        """The ids that spell these bytes, if the tokenizer's do."""
        ids = np.array(tok.encode([text[tok.add_space :].decode("utf-8", "replace")])[0], np.int64)
        same = int(tok.size[ids].sum()) == len(text) and take_runs(tok.flat, tok.start[ids], tok.size[ids]).tobytes() == text
        return ids if same else None

    def _side(self, tok: Tokens, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units laid end to end, their numbers by unit, and which units they spell.

        Units are encoded some kilobytes at once: nothing joins across their starts, unless
        a unit ends in white space, so a block ends there.
        """
        raw = data.tobytes()
        new = np.ones(len(off) - 1, bool)
        new[1:] = odd_space(data)[off[1:-1] - 1] | (off[1:-1] // BLOCK_BYTES != off[:-2] // BLOCK_BYTES)
        if not self.splits:
            new[:] = True
        first = np.append(np.flatnonzero(new), len(off) - 1)
        ids, n, ok = [], np.zeros(len(off) - 1, np.int64), np.ones(len(off) - 1, bool)
        blocks = [raw[off[x] : off[y]] for x, y in zip(first[:-1], first[1:])]
        got = tok.encode([b[tok.add_space :].decode("utf-8", "replace") for b in blocks])
        for x, y, text, found in zip(first[:-1].tolist(), first[1:].tolist(), blocks, got):
            block = np.array(found, np.int64)
            size = tok.size[block]
            ends, cuts = np.cumsum(size), off[x : y + 1] - off[x]
            if len(block) and ends[-1] == len(text) and take_runs(tok.flat, tok.start[block], size).tobytes() == text and np.isin(cuts[1:], ends).all():
                n[x:y] = np.diff(np.searchsorted(ends, cuts, side="right"))
                ids.append(block)
                continue
            for u in range(x, y):
                one = self._ids(tok, raw[off[u] : off[u + 1]])
                ok[u] = one is not None
                if one is not None:
                    n[u] = len(one)
                    ids.append(one)
        return np.concatenate(ids or [np.zeros(0, np.int64)]), n, ok

    def align_units(self, data: np.ndarray, sizes: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For the cache: group text, group ends, links, and counts of (A, B, groups, misspelt) of units laid end to end."""
        off = offsets(sizes)
        a, n_a, ok_a = self._side(self.a, data, off)
        b, n_b, ok_b = self._side(self.b, data, off)
        ok = ok_a & ok_b
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        base = offsets(sizes * ok)
        a_end, b_end = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        a_start, b_start = a_end - self.a.size[a], b_end - self.b.size[b]
        side = np.repeat(np.array([0, 1], np.int8), [len(a), len(b)])
        ids, start, end = np.concatenate((a, b)), np.concatenate((a_start, b_start)), np.concatenate((a_end, b_end))
        order, group = coalesce(start, end, side)
        own = np.empty(len(order), np.int64)
        own[order] = group
        n_groups = int(group[-1]) + 1 if len(group) else 0
        group_end = np.zeros(n_groups, np.int64)
        np.maximum.at(group_end, group, end[order])
        i, j = overlaps(a_start, a_end, b_start, b_end)
        together = a_end[i] == b_end[j]
        i, j = i[together], j[together]
        groups_of = np.diff(np.searchsorted(group_end, base, side="right"))
        text, text_sizes = self._text(ids, own, side, np.lexsort((start, side, own)), offsets(groups_of))
        at_unit = np.searchsorted(base, a_end[i], side="left") - 1
        counts = np.stack((n_a, n_b, groups_of, ~ok), axis=1).astype(np.int32)
        return {
            "text": (text, text_sizes),
            "ends": ((group_end - np.repeat(base[:-1], groups_of)).astype(np.int32), groups_of),
            "links": (a[i] << 32 | b[j], np.bincount(at_unit, minlength=len(sizes))),
            "counts": (counts.ravel(), np.full(len(sizes), 4)),
        }

    def _text(self, ids: np.ndarray, own: np.ndarray, side: np.ndarray, order: np.ndarray, unit_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units' groups as text, ``;a1,a2|b1``: a semicolon, A ids by comma, a bar, B ids by comma; and the units' sizes."""
        ids, own, side = ids[order], own[order], side[order]
        start, size = self.decimal
        flat = take_runs(self.digits, start[ids], size[ids])
        at = offsets(size[ids])
        mark = np.full(len(ids), ord(","), np.uint8)
        group_first = np.searchsorted(own, np.arange(unit_off[-1]))
        mark[1:][side[1:] != side[:-1]] = ord("|")
        mark[group_first] = ord(";")
        flat[at[:-1]] = mark
        return flat, np.diff(at[np.append(group_first, len(ids))][unit_off])

    def align(self, col: pa.Array, names: tuple[str, ...] = ("text", "ends", "links")) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For each row: ``counts`` (A tokens, B tokens, groups) and the named runs with their sizes."""
        data, row_off = with_space(col)
        start = unit_starts(data, row_off, self.splits) if len(data) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(data)))
        key = tv.span_hash(data, tv._BYTE_ALL, start, start + size)
        short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        at = self.cache.places(key[short], lambda new: self.align_units(take_runs(data, start[short[new]], size[short[new]]), size[short[new]]))
        found = {k: self.cache.run(k, at) for k in (*names, "counts")}
        if len(long):
            more = self.align_units(take_runs(data, start[long], size[long]), size[long])
            order = np.argsort(np.concatenate((short, long)), kind="stable")
            for k, (flat, n) in found.items():
                n, both = np.concatenate((n, more[k][1])), np.concatenate((flat, more[k][0].astype(flat.dtype)))
                found[k] = take_runs(both, offsets(n)[:-1][order], n[order]), n[order]
        unit_off = np.searchsorted(start, row_off)
        counts = found.pop("counts")[0].reshape(-1, 4)
        per_row = np.stack([run_sums(counts[:, k], unit_off) for k in range(4)], axis=1)
        spelt = per_row[:, 3] == 0
        out = {"counts": per_row[:, :3] * spelt[:, None]}
        for k, (flat, n) in found.items():
            if k == "ends":
                flat = flat + np.repeat(start - np.repeat(row_off[:-1], np.diff(unit_off)), n).astype(np.int32)
            sizes = run_sums(n, unit_off)
            out[k] = (flat if spelt.all() else flat[np.repeat(spelt, sizes)]), sizes * spelt
        return out


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    """One aligner for each worker process and pair of files."""
    return Aligner(byte_level(a), sentence_piece(b))


# --- operators


def align(docs: DataFrame, a: str, b: str, columns: tuple[str, ...] = tuple(RUNS)) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups and the named columns.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids of A and B by group; ``group_ends`` the byte
    of the space and text at which each group ends; ``links`` the pairs of ids, ``a << 32 | b``, of
    the tokens that end together, in order.  ``a`` is a byte-level BPE's JSON file, ``b`` a
    SentencePiece model.
    """
    tv.bounded_batches(docs.sparkSession)
    names = [c for c in SCHEMA if c not in RUNS or c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a, b)
        for x in tv.slices(batches, most=CHUNK_BYTES):
            got = tool.align(x.column(1), tuple(RUNS[c] for c in names if c in RUNS))
            out = {"doc_id": x.column(0)} | {c: pa.array(got["counts"][:, k], pa.int64()) for k, c in enumerate(("n_a", "n_b", "n_groups"))}
            if "text" in got:
                text, off = got["text"][0].tobytes(), offsets(got["text"][1])
                out["groups"] = pa.array([text[min(p + 1, q) : q].decode() for p, q in zip(off[:-1], off[1:])], pa.string())
            if "ends" in got:
                out["group_ends"] = _lists(got["ends"][0], offsets(got["ends"][1]))
            if "links" in got:
                out["links"] = _longs(*got["links"])
            yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, ", ".join(f"{c} {SCHEMA[c]}" for c in names))


def _longs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets(sizes), pa.int32()), pa.array(values, pa.int64()))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (``a << 32 | b``), n (its links in all texts), best (n is the highest of b's pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            pair, n = np.unique(_runs(x.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counts = table(aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    # One row for each id of B: bounded by its vocabulary.
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return table(counts.join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def frequent(pairs: DataFrame, most: int = FREQUENT) -> int:
    """The lowest power of two such that at most ``most`` pairs are counted as often."""
    by_size = pairs.groupBy((F.length(F.bin("n")) - 1).alias("size")).agg(F.count("*").alias("pairs")).collect()  # at most 63 rows
    low, held = 62, 0
    for r in sorted(by_size, key=lambda r: -r["size"]):
        held += r["pairs"]
        if held > most:
            break
        low = r["size"]
    return 1 << low


def weigh(aligned: DataFrame, pairs: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of ``align`` without ``links``, with n_links, n_best and count_sum of each document."""
    low = frequent(pairs, most)
    head = pairs.filter(F.col("n") >= low).toArrow().sort_by("pair")  # at most ``most`` rows
    known, n, best = (head[c].to_numpy() for c in ("pair", "n", "best"))
    kept = [c for c in aligned.columns if c != "links"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name != "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            links, off = _runs(x.column(x.schema.get_field_index("links")))
            at = np.minimum(np.searchsorted(known, links), max(len(known) - 1, 0))
            hit = known[at] == links if len(known) else np.zeros(len(links), bool)
            at = at[hit]
            value, top = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            value[hit], top[hit] = n[at], best[at]
            yield pa.RecordBatch.from_arrays(
                [*(x.column(x.schema.get_field_index(c)) for c in kept), pa.array(np.diff(off)), pa.array(run_sums(top, off)), pa.array(run_sums(value, off)), _longs(links[~hit], run_sums(~hit, off))],
                names=[*kept, "n_links", "n_best", "count_sum", "rest"],
            )

    rows = aligned.mapInArrow(run, f"{schema}, n_links long, n_best long, count_sum long, rest array<bigint>")
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    rare = rows.select("row", F.explode("rest").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    rare = rare.join(pairs.filter(F.col("n") < low), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    return rows.join(rare, "row", "left").select(
        *kept, "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum")
    )
