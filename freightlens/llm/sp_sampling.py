"""Sampled segmentations of a SentencePiece model without replacement, and decoding.

A text, with spaces as the model's space mark and one put before it, is cut into units:
a run of space marks and what follows up to the next, cut before an ASCII mark after a letter.  A unit's lattice has an edge for
each piece of the model that matches at a place, and for each byte of a character no
piece starts at (byte fallback).  A path's weight is the product of its pieces'
weights; piece number r (by its rank in the model) weighs ``1 / (r + RANK_OFFSET)``, so
few and frequent pieces are likely.  A text's segmentations are the paths through all
its units; p is a path's weight over the sum of all.

``encode_samples`` draws ``k`` distinct segmentations of each text by Gumbel top-k: every
segmentation gets log p plus a Gumbel variate, the k largest are its sample without
replacement.  They are found best first without listing them.  A node of the search
is a prefix and what may follow; its perturbed value is the largest below it.
The root's value is a Gumbel variate; below it the chosen edge keeps its node's value,
and all other edges together get a Gumbel variate of their mass, truncated at it.  Such sets
of edges wait, as bounds, in the queue of A*; the largest is taken next, one of its
edges is drawn, and the path is completed after it.  Since a chosen edge keeps the
value, all units of a text, and all texts of a batch, are sampled at once in numpy.

Random numbers come from a hash of the seed, the row's key and the draw's place: a
row's sample does not depend on its neighbours, partitions or retries.  The inclusion
score of a segmentation is the chance that it is among those whose perturbed value
exceeds the sample's threshold (the k+1-th largest value): 1 - exp(-exp(log p - kappa)).
A text with no more than k segmentations gives all of them, with score 1.

Defined cases: a null or empty text has one empty segmentation; ties cannot
occur but with probability 0 and go to the earlier place; rows are independent; the key is
doc_id, so equal rows draw alike and null is a key of its own; an empty table gives an empty
result; columns besides doc_id and text are not read.  Units of more than MOST_UNIT
bytes are cut at that length, at a character's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from freightlens.llm import textvec as tv

RANK_OFFSET = 100.0
MOST_UNIT = 48
SPACE_MARK = "▁"
KEEP_UNITS = 500_000
CHUNK = 1 << 20


class Pieces:
    """The model's pieces by byte hash, with weights, and its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        n = model.get_piece_size()
        self.text: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        normal: list[int] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.text.append(b"")
            else:
                raw = piece.encode()
                self.text.append(raw.replace(SPACE_MARK.encode(), b" "))
                if len(self.text[-1]) <= MOST_UNIT:
                    normal.append(i)
        raws = [self.text[i] for i in normal]
        size = np.array([len(x) for x in raws])
        data = np.frombuffer(b"".join(raws), np.uint8)
        start = np.cumsum(size) - size
        self.index = tv.HashIndex(17)
        self.index.add(_roll(data, start, size))
        self.longest = int(size.max())
        self.id = np.array(normal, np.int32)
        first = min(normal)
        self.logw = -np.log(self.id - first + RANK_OFFSET)
        self.byte_logw = -np.log(n + RANK_OFFSET)


def _roll(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = np.zeros(len(start), np.uint64)
    longest = int(size.max()) if len(size) else 0
    padded = np.concatenate((data, np.zeros(longest, np.uint8)))
    for j in range(longest):
        h = np.where(size > j, h * np.uint64(0x100000001B3) + padded[start + j] + np.uint64(1), h)
    return tv.mix(h)


def random(key: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on these alone."""
    h = tv.mix(tv.mix(key + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) ^ place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def units(col: pa.Array) -> tv.Words:
    """Units of the texts with a space put before each non-empty one; other white space is text."""
    data, off = tv.text_buffer(col)
    n = np.diff(off)
    rows = np.flatnonzero(n)
    spaced = np.insert(data, off[:-1][rows], 32)
    off = np.concatenate(([0], np.cumsum(n + (n > 0))))
    if len(spaced) == 0:
        z = np.zeros(0, np.int64)
        return tv.Words(spaced, off, z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
    space = spaced == 32
    begin = np.zeros(len(spaced), bool)
    begin[1:] = (space[1:] & ~space[:-1]) | (tv._LETTER[spaced[:-1]] & tv._MARK[spaced[1:]])
    begin[off[:-1][rows]] = True
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(spaced)))
    if len(size) and size.max() > MOST_UNIT:
        long = np.flatnonzero(size > MOST_UNIT)
        more = []
        for i in long.tolist():
            a, end = int(start[i]), int(start[i] + size[i])
            while end - a > MOST_UNIT:
                a += MOST_UNIT
                while spaced[a] & 0xC0 == 0x80:
                    a -= 1
                more.append(a)
        start = np.unique(np.concatenate((start, more)))
    until = np.append(start[1:], len(spaced))
    return tv.Words(spaced, off, start, until, tv.span_hash(spaced, tv._BYTE_ALL, start, until), np.searchsorted(start, off))


class Lattices:
    """Lattices of distinct units in flat arrays: an edge list for each place, with the
    log weight of all ways from the edge's end to the unit's end (``rest``)."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.index = tv.HashIndex()
        self.place = [np.zeros(0, np.int64)]  # of each unit, its first place
        self.first = np.zeros(1, np.int64)  # of each place, its first edge; one more at the end
        self.piece = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int8)
        self.share = np.zeros(0)  # chance of the edge, given its place
        self.unit_place = np.zeros(0, np.int64)

    def add(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> None:
        p = self.pieces
        order = np.argsort(size, kind="stable")
        start, size, hashes = start[order], size[order], hashes[order]
        width = int(size.max())
        padded = np.concatenate((data, np.zeros(width + p.longest, np.uint8)))
        n = len(start)
        place0 = len(self.first) - 1 + np.cumsum(size) - size
        log_all = np.full((n, width + 1), -np.inf)  # ways from a place to the end
        log_all[np.arange(n), size] = 0.0
        edges: list[tuple[np.ndarray, ...]] = []
        for at in range(width - 1, -1, -1):
            live = np.flatnonzero(size > at)
            b0 = padded[start[live] + at]
            h = np.zeros(len(live), np.uint64)
            scores = []
            matched = np.zeros(len(live), bool)
            for length in range(1, p.longest + 1):
                h = h * np.uint64(0x100000001B3) + padded[start[live] + at + length - 1] + np.uint64(1)
                fits = np.flatnonzero(at + length <= size[live])
                if len(fits) == 0:
                    break
                found = p.index.find(tv.mix(h[fits]))
                ok = fits[found >= 0]
                k = found[found >= 0]
                if len(ok):
                    s = p.logw[k] + log_all[live[ok], at + length]
                    good = np.isfinite(s)
                    ok, k, s = ok[good], k[good], s[good]
                    matched[ok] = True
                    scores.append((ok, p.id[k], np.full(len(ok), length, np.int8), s))
            # byte fallback where no piece leads on: all bytes of the character, one by one
            bare = np.flatnonzero(~matched)
            if len(bare):
                scores.append((bare, p.byte_id[b0[bare]], np.ones(len(bare), np.int8), p.byte_logw + log_all[live[bare], at + 1]))
            ok, ids, lens, s = (np.concatenate(x) for x in zip(*scores))
            top = np.full(len(live), -np.inf)
            np.maximum.at(top, ok, s)
            total = np.bincount(ok, np.exp(s - top[ok]), len(live))
            log_all[live, at] = top + np.log(total)
            edges.append((place0[live[ok]] + at, ids, lens, np.exp(s - log_all[live[ok], at])))
        where, ids, lens, share = (np.concatenate(x) for x in zip(*edges))
        order = np.lexsort((-share, where))
        places = int(size.sum())
        count = np.bincount(where - (len(self.first) - 1), minlength=places)
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(count)))
        self.piece = np.concatenate((self.piece, ids[order]))
        self.size = np.concatenate((self.size, lens[order]))
        self.share = np.concatenate((self.share, share[order]))
        self.unit_place = np.concatenate((self.unit_place, place0))
        self.index.add(hashes)

    def find(self, u: tv.Words) -> np.ndarray:
        """The first place of each unit's lattice; new units are added."""
        at = self.index.find(u.hash)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if self.index.n > KEEP_UNITS:
                self.clear()
                miss = np.arange(len(u.hash))
            h, first = np.unique(u.hash[miss], return_index=True)
            i = miss[first]
            self.add(u.data, u.start[i], (u.end - u.start)[i], h)
            at = self.index.find(u.hash)
        return self.unit_place[at]


def _truncated(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variate at ``log_mass``, given that it is below ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        g = log_mass - np.log(-np.log(u))
        # -log(exp(-bound) - exp(-top) + exp(-g)) with top infinite, in a stable form
        v = bound - g
        return np.where(np.isneginf(log_mass), -np.inf, bound - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v))))


def _largest(v: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places, in order, of each row's ``most`` largest values; rows ascend, ties go to the earlier."""
    if len(v) == 0:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    size = np.diff(np.append(start, len(v)))
    left, found = v.copy(), []
    for _ in range(most):
        top = np.repeat(np.maximum.reduceat(left, start), size)
        hit = np.flatnonzero((left == top) & ~np.isneginf(left))
        hit = hit[np.concatenate(([True], row[hit][1:] != row[hit][:-1]))] if len(hit) else hit
        found.append(hit)
        left[hit] = -np.inf
    return np.sort(np.concatenate(found))


class Search:
    """The k largest perturbed segmentations of each row of a batch, and the next value."""

    def __init__(self, lat: Lattices, place: np.ndarray, off: np.ndarray, bytes_: np.ndarray, key: np.ndarray):
        self.lat, self.place, self.off, self.bytes = lat, place, off, bytes_
        self.key = key
        self.unit_row = np.repeat(np.arange(len(off) - 1), np.diff(off))

    def complete(self, units_: np.ndarray, at: np.ndarray, round_: int) -> tuple[np.ndarray, ...]:
        """Sampled steps of these units from these byte places on, in order of unit and place:
        unit, byte place, edge, log chance of the edge and of all others there."""
        lat, steps = self.lat, []
        live, pos = units_, at.astype(np.int64)
        while len(live):
            go = pos < self.bytes[live]
            live, pos = live[go], pos[go]
            if len(live) == 0:
                break
            a, b = lat.first[self.place[live] + pos], lat.first[self.place[live] + pos + 1]
            u = random(self.key[self.unit_row[live]], (live - self.off[self.unit_row[live]]) * 64 + pos, round_ * 4 + 1)
            edge, left = a.copy(), u - lat.share[a]
            more = np.flatnonzero((left >= 0) & (edge + 1 < b))
            while len(more):
                edge[more] += 1
                left[more] -= lat.share[edge[more]]
                more = more[(left[more] >= 0) & (edge[more] + 1 < b[more])]
            steps.append((live, pos, edge, lat.share[edge], b - a))
            pos = pos + lat.size[edge]
        if not steps:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0), z
        out = [np.concatenate(x) for x in zip(*steps)]
        order = np.lexsort((out[1], out[0]))
        return tuple(x[order] for x in out)

    def sample(self, k: int) -> tuple[list, np.ndarray]:
        """For each round the rows' paths (steps), log p and values; and the values that come next."""
        lat, rows = self.lat, len(self.off) - 1
        n_units = len(self.place)
        value = -np.log(-np.log(random(self.key, np.zeros(rows, np.int64), 0)))
        # the current path of every row, as steps
        path = self.complete(np.arange(n_units), np.zeros(n_units, np.int64), 0)
        live = np.ones(rows, bool)
        # what waits: per row a list of sets of edges, held in flat arrays
        wait_row, wait_value, wait_unit, wait_pos, wait_used, wait_lp, wait_round = (np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, object, float, np.int64))
        results = []
        fresh_from = np.full(rows, -1, np.int64)  # steps at or after this order are new in this round
        paths_of: list[tuple] = []
        for round_ in range(k):
            unit, pos, edge, share, count = path
            row = self.unit_row[unit]
            logs = np.log(share)
            c = np.concatenate(([0.0], np.cumsum(logs)))
            step_off = np.searchsorted(row, np.arange(rows + 1))
            lp = c[step_off[1:]] - c[step_off[:-1]]
            results.append((path, step_off, lp, value.copy(), live.copy()))
            # siblings of the new steps: a set each, unless the edge was alone
            order = unit * 64 + pos
            new = live[row] & (order > fresh_from[row]) & (count > 1)
            i = np.flatnonzero(new)
            before = c[i] - c[step_off[row[i]]]
            mass = before + np.log(np.maximum(1 - share[i], 1e-300))
            u = random(self.key[row[i]], (unit[i] - self.off[row[i]]) * 64 + pos[i], round_ * 4 + 2)
            v = _truncated(mass, value[row[i]], u)
            # a row takes k - round_ - 1 sets at most from here on, and one more bounds the sample
            top = _largest(v, row[i], k - round_)
            i, v, before = i[top], v[top], before[top]
            used = np.empty(len(i), object)
            used[:] = [(e,) for e in edge[i].tolist()]
            wait_row, wait_value = np.concatenate((wait_row, row[i])), np.concatenate((wait_value, v))
            wait_unit, wait_pos = np.concatenate((wait_unit, unit[i])), np.concatenate((wait_pos, pos[i]))
            wait_used, wait_lp = np.concatenate((wait_used, used)), np.concatenate((wait_lp, before))
            wait_round = np.concatenate((wait_round, np.full(len(i), round_)))
            # the largest set of each row; ties to the earlier place
            by = np.lexsort((wait_pos, wait_unit, -wait_value, wait_row))
            r = wait_row[by]
            head = np.ones(len(by), bool)
            head[1:] = r[1:] != r[:-1]
            best = by[head]
            value = np.full(rows, -np.inf)
            value[wait_row[best]] = wait_value[best]
            paths_of.append((path, step_off))
            live = np.isfinite(value)
            if round_ == k - 1:
                break
            # keep, of what waits, k - round_ sets of each row at most: the others can't be among the k
            rank = np.arange(len(by)) - np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
            stay = np.sort(by[(rank > 0) & (rank <= k - round_)])
            path, more = self._next(best, (wait_row, wait_value, wait_unit, wait_pos, wait_used, wait_lp, wait_round), paths_of, round_ + 1, rows)
            fresh_from = np.full(rows, np.iinfo(np.int64).max)
            fresh_from[wait_row[best]] = wait_unit[best] * 64 + wait_pos[best]
            wait_row, wait_value, wait_unit, wait_pos, wait_used, wait_lp, wait_round = (np.concatenate((x[stay], y)) for x, y in zip((wait_row, wait_value, wait_unit, wait_pos, wait_used, wait_lp, wait_round), more))
        return results, value

    def _next(self, best: np.ndarray, wait: tuple, paths_of: list, round_: int, rows: int) -> tuple[tuple, tuple]:
        """Draw an edge from each best set, complete the paths, and put back what is left of the sets."""
        lat = self.lat
        row, value, unit, pos, used, before, of = (x[best] for x in wait)
        a, b = lat.first[self.place[unit] + pos], lat.first[self.place[unit] + pos + 1]
        u = random(self.key[row], (unit - self.off[row]) * 64 + pos, round_ * 4 + 3)
        edge = np.zeros(len(best), np.int64)
        rest = np.zeros(len(best))
        for j in range(len(best)):
            out = set(used[j])
            left = [e for e in range(a[j], b[j]) if e not in out]
            mass = np.cumsum(lat.share[left])
            pick = min(int(np.searchsorted(mass, u[j] * mass[-1], side="right")), len(left) - 1)
            edge[j] = left[pick]
            rest[j] = mass[-1] - lat.share[left[pick]] if len(left) > 1 else 0.0
        lists = np.empty(len(best), object)
        lists[:] = [(*x, int(e)) for x, e in zip(used, edge)]
        with np.errstate(divide="ignore"):
            again = _truncated(before + np.log(rest), value, random(self.key[row], (unit - self.off[row]) * 64 + pos, round_ * 4 + 2))
        keep = np.isfinite(again) & (rest > 0)
        more = tuple(x[keep] for x in (row, again, unit, pos, lists, before, of))
        # paths: steps before the set's place as in its round, the edge, and new steps after it
        parts = []
        for number in np.unique(of):
            path, off = paths_of[number]
            mine = np.flatnonzero(of == number)
            limit = np.full(rows, -1, np.int64)
            limit[row[mine]] = unit[mine] * 64 + pos[mine]
            s_unit, s_pos = path[0], path[1]
            old = np.flatnonzero(s_unit * 64 + s_pos < limit[self.unit_row[s_unit]])
            parts.append(tuple(x[old] for x in path))
        parts.append((unit, pos, edge, lat.share[edge], b - a))
        # the unit itself from the edge's end, and all units after it in the row
        after = np.repeat(self.off[row + 1] - unit - 1, 1)
        total = np.concatenate(([0], np.cumsum(after)))
        later = np.arange(total[-1]) - np.repeat(total[:-1] - unit - 1, after)
        parts.append(self.complete(np.concatenate((unit, later)), np.concatenate((pos + lat.size[edge], np.zeros(len(later), np.int64))), round_))
        cols = [np.concatenate(x) for x in zip(*parts)]
        order = np.lexsort((cols[1], cols[0]))
        return tuple(x[order] for x in cols), more


_LATTICES: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(Pieces(path))
    return _LATTICES[path]


def sample_column(col: pa.Array, keys: np.ndarray, lat: Lattices, k: int) -> list[tuple]:
    """For each rank: rows that have it, offsets and ids, log p, perturbed values, inclusion."""
    u = units(col)
    rows = len(u.row_off) - 1
    if len(u.start) == 0:
        one = np.zeros(rows)
        return [(np.arange(rows), np.zeros(rows + 1, np.int64), np.zeros(0, np.int32), one, -np.log(-np.log(random(keys, np.zeros(rows, np.int64), 0))), np.ones(rows))]
    s = Search(lat, lat.find(u), u.off, u.end - u.start, keys)
    results, kappa = s.sample(k)
    out = []
    for path, off, lp, value, live in results:
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(lp - kappa))
        ids = lat.piece[path[2]]
        have = np.flatnonzero(live)
        sizes = np.diff(off)[have]
        if len(have) < rows:
            ids = ids[np.repeat(live, np.diff(off))]
        out.append((have, np.concatenate(([0], np.cumsum(sizes))), ids, lp[have], value[have], np.where(np.isneginf(kappa[have]), 1.0, inclusion[have])))
    return out


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of a segmentation: its pieces' bytes without the space put before."""
    raw = b"".join(pieces.text[i] for i in ids)
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


SCHEMA = "doc_id long, sample int, ids array<int>, n_pieces long, log_p double, perturbed double, inclusion double, round_trip boolean"


def _same(col: pa.Array, have: np.ndarray, off: np.ndarray, ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Whether each row's ids decode to its text: the bytes are put together and compared."""
    data, row_off = tv.text_buffer(col)
    table = getattr(pieces, "flat", None)
    if table is None:
        size = np.array([len(t) for t in pieces.text])
        table = pieces.flat = (np.frombuffer(b"".join(pieces.text), np.uint8), np.cumsum(size) - size, size)
    flat, start, size = table
    n = size[ids]
    total = np.concatenate(([0], np.cumsum(n)))
    made = flat[np.arange(total[-1]) - np.repeat(total[:-1] - start[ids], n)]
    made_off = total[off]
    want = np.diff(row_off)[have]
    same = np.diff(made_off) == want + (want > 0)
    for j in np.flatnonzero(same).tolist():
        a, r = int(made_off[j]), int(have[j])
        if want[j]:
            same[j] = np.array_equal(made[a + 1 : int(made_off[j + 1])], data[row_off[r] : row_off[r + 1]])
    return same


def encode_samples(docs: DataFrame, model: str, k: int = 2, seed: int = 17) -> DataFrame:
    """One row for each document and sampled segmentation, in ``SCHEMA``; sample counts from 0."""
    tv.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for b in tv.slices(batches, most=CHUNK):
            raw = b.column(0)
            keys = tv.mix(raw.fill_null(-(2**62) - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed))
            for rank, (have, off, ids, lp, value, inclusion) in enumerate(sample_column(b.column(1), keys, lat, k)):
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
                same = _same(b.column(1), have, off, ids, lat.pieces)
                yield pa.RecordBatch.from_arrays(
                    [raw.take(pa.array(have)), pa.array(np.full(len(have), rank, np.int32)), lists, pa.array(np.diff(off), pa.int64()), pa.array(lp), pa.array(value), pa.array(inclusion), pa.array(same)],
                    names=[f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
