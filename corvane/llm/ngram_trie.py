"""A compact n-gram trie: Elias-Fano levels in memory-mapped files.

``EliasFano`` stores a monotone sequence of n numbers below u in about
n * (2 + log2(u / n)) bits: the low bits side by side, the high bits in unary with
the position of every 64th one kept as a sample.

``Trie`` has two levels. The first holds the sorted distinct contexts and a monotone
pointer per context to where its successors begin; the second holds, context by
context, the successors (made monotone over the whole level by adding the running
sum of context ranges) and one quantised value each. A query finds its context, reads its
pointers, and searches its successor in that context's range alone.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

#: Counts below this are stored exactly, larger ones in steps of half a percent.
EXACT, STEP = 1024, 1.005
#: Successors that a search decodes at a time (8 bytes each).
STRIDE = 1 << 16


def quantise(values: np.ndarray) -> np.ndarray:
    """Counts (at least 0) to 16-bit codes."""
    v = np.asarray(values, dtype=np.float64)
    big = EXACT + np.rint(np.log(np.maximum(v, EXACT) / EXACT) / np.log(STEP))
    return np.where(v < EXACT, v, np.minimum(big, 65535)).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    c = np.asarray(codes, dtype=np.float64)
    return np.where(c < EXACT, c, EXACT * STEP ** np.maximum(c - EXACT, 0))


class EliasFano:
    """A monotone sequence; reads go to the arrays, which may be memory-mapped."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, int(np.floor(np.log2(max(universe, 1) / n)))) if n else 0
        # low parts as whole bytes, byte plane by byte plane
        low_bits = min(56, -(-low_bits // 8) * 8)
        planes = [((values >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8) for k in range(low_bits // 8)]
        low = np.concatenate(planes) if planes else np.empty(0, np.uint8)
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        length = (int(top[-1]) if n else 0) + n + 1
        bits = np.zeros(length, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(bits, np.arange(0, length, 512)), dtype=np.int64)])
        return cls(n, low_bits, low, high, ones)

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0][: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits // 8):
            out |= self.low[k * self.n : (k + 1) * self.n].astype(np.uint64) << np.uint64(8 * k)
        return out

    def between(self, lo: int, hi: int) -> np.ndarray:
        """The values at the positions from ``lo`` up to ``hi``."""
        if lo >= hi:
            return np.empty(0, np.uint64)
        first, last = (int(p) for p in self.select(np.array([lo, hi - 1])))
        start = first // 8
        bits = np.unpackbits(self.high[start : last // 8 + 1], bitorder="little")
        ones = np.nonzero(bits[first - start * 8 :])[0][: hi - lo] + first
        out = (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits // 8):
            out |= self.low[k * self.n + lo : k * self.n + hi].astype(np.uint64) << np.uint64(8 * k)
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ranks]

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at some positions: select of the at-th one, then the low bits."""
        at = np.asarray(at, dtype=np.int64)
        value = (self.select(at) - at).astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits // 8):
            value |= self.low[k * self.n + at].astype(np.uint64) << np.uint64(8 * k)
        return value

    def select(self, at: np.ndarray) -> np.ndarray:
        """The bit positions of some ones, found from the counts before every 64th byte."""
        block = np.searchsorted(self.ranks, at, side="right") - 1
        left = (at - self.ranks[block]).astype(np.int64)
        out = np.zeros(len(at), np.int64)
        for s in range(0, len(at), 65536):
            part = slice(s, s + 65536)
            start = block[part] * 64
            idx = np.minimum(start[:, None] + np.arange(64)[None, :], len(self.high) - 1)
            window = self.high[idx]
            window[start[:, None] + np.arange(64)[None, :] >= len(self.high)] = 0
            ones = _POPCOUNT[window]
            total = np.cumsum(ones, axis=1)
            byte = (total <= left[part][:, None]).sum(axis=1)
            row = np.arange(len(byte))
            rest = left[part] - np.where(byte > 0, total[row, byte - 1], 0)
            bit = _SELECT[window[row, byte], rest]
            out[part] = (start + byte) * 8 + bit
        return out


_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.int64)
_SELECT = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[:8] for x in range(256)], np.int64)


class Trie:
    """Contexts, their successors and a quantised value per n-gram."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, values: np.ndarray, width: int) -> None:
        self.contexts, self.pointers, self.successors, self.values, self.width = contexts, pointers, successors, values, width
        self.file: mmap.mmap | None = None

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, count: np.ndarray, context_bits: int, successor_bits: int) -> Trie:
        """From distinct n-grams sorted by (context, successor)."""
        heads, starts = np.unique(context, return_index=True)
        rank = np.searchsorted(heads, context)
        level = successor.astype(np.uint64) + (rank.astype(np.uint64) << np.uint64(successor_bits))
        pointers = np.append(starts, len(context)).astype(np.uint64)
        return cls(
            EliasFano.of(heads, 1 << context_bits),
            EliasFano.of(pointers, len(context) + 1),
            EliasFano.of(level, max(1, len(heads)) << successor_bits),
            quantise(count),
            successor_bits,
        )

    def mapped(self) -> Trie:
        """The same trie over a file of this task's own temporary folder, memory-mapped.

        The file is unlinked at once: it lives as long as the mapping.
        """
        parts = [a for level in (self.contexts, self.pointers, self.successors) for a in level.arrays()] + [self.values]
        fd, name = tempfile.mkstemp(prefix="trie")
        os.unlink(name)
        spans = []
        with os.fdopen(fd, "wb+") as f:
            for a in parts:
                f.write(b"\0" * (-f.tell() % 8))
                spans.append((f.tell(), a.dtype, len(a)))
                f.write(a.tobytes())
            f.write(b"\0" * 8)
            f.flush()
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self.file, d, n, at) for at, d, n in spans]
        for k, level in enumerate((self.contexts, self.pointers, self.successors)):
            level.low, level.high, level.ranks = views[3 * k : 3 * k + 3]
        self.values = views[9]
        return self

    def lookup(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The value codes of some n-grams, 0 where the trie has none.

        Queries are taken context by context: the pointers give the range of a context's
        successors, which alone is decoded and searched, relative to its context. Ranges
        of neighbouring contexts are decoded together, ``STRIDE`` successors at a time.
        """
        out = np.zeros(len(context), np.uint16)
        if not self.contexts.n or not len(context):
            return out
        heads = self.contexts.decode()
        c = np.minimum(np.searchsorted(heads, context), len(heads) - 1)
        known = np.nonzero(heads[c] == context)[0]
        known = known[np.lexsort((successor[known], c[known]))]
        c = c[known]
        want = successor[known].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(self.width))
        asked = np.unique(c)
        begin, end = (self.pointers.get(asked + k).astype(np.int64) for k in (0, 1))
        at = 0
        while at < len(asked):
            # as many asked contexts as lie within a stride of successors, at least one
            stop = max(at + 1, int(np.searchsorted(end, begin[at] + STRIDE, side="right")))
            lo, hi = int(begin[at]), int(end[stop - 1])
            rows = slice(int(np.searchsorted(c, asked[at])), int(np.searchsorted(c, asked[stop - 1], side="right")))
            level = self.successors.between(lo, hi)
            place = np.minimum(np.searchsorted(level, want[rows]), len(level) - 1)
            hit = np.nonzero(level[place] == want[rows])[0]
            out[known[rows][hit]] = self.values[lo + place[hit]]
            at = stop
        return out
