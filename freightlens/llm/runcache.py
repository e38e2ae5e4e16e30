"""Results kept by key in flat arrays, and helpers on runs laid end to end."""

from __future__ import annotations

import numpy as np

from freightlens.llm.textvec import HashIndex


def offsets(sizes: np.ndarray) -> np.ndarray:
    """The n+1 positions of runs of these sizes laid end to end."""
    return np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))


def take_runs(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start[i]:start[i] + sizes[i]]`` of all i, end to end."""
    off = offsets(sizes)
    return flat[np.arange(off[-1]) + np.repeat(start - off[:-1], sizes)]


def run_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whole-number sums of consecutive runs; empty runs give 0."""
    c = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


class RunCache:
    """For each 64-bit key a run in each of several flat arrays.

    When it would hold more than ``keep`` keys, those asked for twice since the last time stay (the
    most frequent half of ``keep``) and the others go.  ``make(positions)`` is asked for the runs of
    keys that are absent and gives, for each array, the runs end to end and their sizes.
    """

    def __init__(self, kinds: dict[str, type], keep: int):
        self.kinds, self.keep = kinds, keep
        self._clear()

    def _clear(self) -> None:
        self.index = HashIndex()
        self.hits = np.zeros(1 << 12, np.int32)
        self.flat = {k: np.zeros(1 << 14, t) for k, t in self.kinds.items()}
        self.off = {k: np.zeros(1 << 12, np.int64) for k in self.kinds}

    def _shrink(self) -> None:
        n = self.index.n
        key = np.zeros(n, np.uint64)
        used = self.index.val >= 0
        key[self.index.val[used]] = self.index.key[used]
        often = np.argsort(-self.hits[:n], kind="stable")[: self.keep // 2]
        often = np.sort(often[self.hits[often] > 1])
        runs = {k: self.run(k, often) for k in self.kinds}
        self._clear()
        self._add(key[often], runs)

    def _add(self, keys: np.ndarray, runs: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        for name, (flat, sizes) in runs.items():
            self._append(name, flat, sizes)
        self.index.add(keys)
        if self.index.n > len(self.hits):
            self.hits = np.concatenate((self.hits, np.zeros(self.index.n, np.int32)))

    def _append(self, name: str, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, at = self.index.n, int(self.off[name][self.index.n])
        while at + len(flat) > len(self.flat[name]):
            self.flat[name] = np.concatenate((self.flat[name], np.zeros_like(self.flat[name])))
        while n + len(sizes) + 1 > len(self.off[name]):
            self.off[name] = np.concatenate((self.off[name], np.zeros_like(self.off[name])))
        self.flat[name][at : at + len(flat)] = flat
        self.off[name][n + 1 : n + 1 + len(sizes)] = at + np.cumsum(sizes)

    def places(self, keys: np.ndarray, make) -> np.ndarray:
        """The place of each key, for ``run``."""
        at = self.index.find(keys)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            if self.index.n and self.index.n + len(new) > self.keep:
                self._shrink()
                at = self.index.find(keys)
                miss = np.flatnonzero(at < 0)
                new, first = np.unique(keys[miss], return_index=True)
            self._add(new, make(miss[first]))
            at[miss] = self.index.find(keys[miss])
        self.hits[: self.index.n] += np.bincount(at, minlength=self.index.n).astype(np.int32)
        return at

    def run(self, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs at these places end to end, and their sizes."""
        off = self.off[name]
        sizes = off[at + 1] - off[at]
        return take_runs(self.flat[name], off[at], sizes), sizes
