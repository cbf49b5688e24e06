"""Words and word shingles of a text as 64-bit numbers, in whole-array steps.

A word is a run of ASCII letters and digits or of any characters beyond ASCII, after
lower-casing. A word's number is a polynomial over its bytes modulo 2^64, mixed; a
shingle's is a polynomial over the numbers of its words, mixed. No word becomes a
Python object, so a text costs a few array passes.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_WINDOW = 1 << 18  # bytes whose powers are held at once

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[128:] = True
for _first, _last in ("09", "az", "AZ"):
    _WORD_BYTE[ord(_first) : ord(_last) + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: nearby inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(30))  # an array of its own, changed in place from here on
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def lowered(text: str) -> np.ndarray:
    """The bytes of a text in lower case."""
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)


class WordHasher:
    """``words(text)``: numbers and byte bounds of the words of a text."""

    def __init__(self):
        self.up = _powers(_BASE, _WINDOW)
        self.down = _powers(pow(_BASE, -1, 1 << 64), _WINDOW)

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words_of(lowered(text))

    def words_of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of the bytes of :func:`lowered`."""
        inside = _WORD_BYTE[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            origin = starts[at]
            stop = max(at + 1, int(np.searchsorted(ends, origin + _WINDOW, side="right")))
            size = int(ends[stop - 1] - origin)
            if size <= _WINDOW:
                up, down = self.up[:size], self.down
            else:  # one word longer than the window
                up, down = _powers(_BASE, size), self.down
            total = np.empty(size + 1, dtype=np.uint64)
            total[0] = 0
            letters = data[origin : origin + size].astype(np.uint64)
            letters += np.uint64(1)
            letters *= up
            np.cumsum(letters, out=total[1:])
            s, e = starts[at:stop] - origin, ends[at:stop] - origin
            out[at:stop] = (total[e] - total[s]) * down[s]
            at = stop
        return mix(out), starts, ends

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Numbers of the runs of ``n`` words, in order; none if there are fewer words."""
        if len(words) < n:
            return np.empty(0, dtype=np.uint64)
        out = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            out = out * np.uint64(_STEP) + words[k : len(words) - n + 1 + k]
        return mix(out)

    def shingles(self, text: str, n: int) -> np.ndarray:
        """Sorted distinct shingles; a text of fewer than ``n`` words is one shingle, without words it has none."""
        words, _, _ = self.words(text)
        if len(words) == 0:
            return words
        return np.unique(self.grams(words, min(n, len(words))))


class MinHasher:
    """``hashes`` smallest values of multiply-shift functions over shingles."""

    def __init__(self, hashes: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(shingles), 512):
            values = shingles[at : at + 512, None] * self.a + self.b
            low = np.minimum(low, (values >> np.uint64(32)).min(axis=0).astype(np.uint32))
        return low
