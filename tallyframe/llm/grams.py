"""Word shingles as sorted arrays of 64-bit hashes, and the cut of their global order.

Words are maximal runs of characters other than ASCII white space (``\\x20``,
``\\x09``-``\\x0D``), after lower-casing A-Z only; ``bytes.lower`` and ``bytes.split``
do exactly that on UTF-8. A shingle is hashed from its words' xxHash64 values, and the
*global order* of all shingles is the order of those hashes, so every task knows it
without talking to the others.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import xxhash

MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class WordHashes(dict):
    """Word -> xxHash64, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mixed(a: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    a = (a ^ (a >> np.uint64(31))) * MIX[0]
    a = (a ^ (a >> np.uint64(29))) * MIX[1]
    return a ^ (a >> np.uint64(32))


def shingles(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """The distinct ``width``-word shingles of ``text``, sorted by hash. Fewer words than
    ``width``: the whole sequence as one shingle. No text or no words: empty."""
    if not text:
        return np.empty(0, np.uint64)
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    w = min(width, len(a))
    n = len(a) - w + 1
    s = np.full(n, MIX[2] + np.uint64(w) if w < width else MIX[2], np.uint64)
    for k in range(w):
        s = (s ^ a[k:n + k]) * MIX[k % 2]
        s ^= s >> np.uint64(29)
    return np.unique(mixed(s))


class Fragments:
    """Cuts of the global order that make links visible as equal fragments.

    Two sets link when ``100 * intersection >= percent * union``. Sizes are divided into
    bands so that linked sets lie in the same or in neighbouring bands. *Level* ``b``
    serves sets of band ``b`` with sets of bands ``b`` and ``b + 1``; a linked pair there
    differs in at most ``k`` shingles. The level cuts the global order into
    ``k + 1 + spare`` equal fragments, so at least ``spare + 1`` fragments hold exactly the
    same shingles in both sets. Fragments empty in both are no evidence; sets with more
    than ``spare`` empty fragments therefore also publish these (both sides of a pair that
    would need them do), and no link is lost.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def _band(self, n: int) -> int:
        while self.lows[-1] <= n:
            low = self.lows[-1]
            self.lows.append(max(low + 1, (low - 1) * 100 // self.percent + 1))
        lo, hi = 0, len(self.lows) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.lows[mid] <= n else (lo, mid)
        return lo

    @lru_cache(maxsize=4096)  # noqa: B019  one object per task
    def level(self, b: int) -> tuple[int, int]:
        """(number of fragments, spare) of level ``b``; 0 fragments if only equal sets link."""
        while len(self.lows) < b + 3:
            low = self.lows[-1]
            self.lows.append(max(low + 1, (low - 1) * 100 // self.percent + 1))
        m = self.lows[b + 1] - 1
        n = min(self.lows[b + 2] - 1, m * 100 // self.percent)
        k = (m + n) * (100 - self.percent) // (100 + self.percent)
        if k == 0:
            return 0, 0
        spare = 0
        for _ in range(4):
            f = k + 1 + spare
            mean = f * math.exp(-self.lows[b] / f)
            spare = math.ceil(mean + 4 * math.sqrt(mean))
        return k + 1 + spare, spare

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of (level, fragment, its shingles) that a set publishes."""
        if not len(grams):
            return np.empty(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams), dtype=np.uint64)])
        band, out = self._band(len(grams)), []
        for b in ((band, band - 1) if band else (band,)):
            f, spare = self.level(b)
            if not f:
                continue
            cut = np.searchsorted(grams, self._bounds(f))
            size = np.diff(cut)
            value = sums[cut[1:]] - sums[cut[:-1]]
            tag = np.arange(f, dtype=np.uint64) + np.uint64(b << 32)
            sig = mixed(value ^ mixed(tag ^ MIX[2]))
            empty = int((size == 0).sum())
            out.append(sig if empty > spare else sig[size > 0])
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    @lru_cache(maxsize=4096)  # noqa: B019
    def _bounds(self, f: int) -> np.ndarray:
        return np.array([(i << 64) // f for i in range(f)] + [(1 << 64) - 1], np.uint64)
