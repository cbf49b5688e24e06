"""Ids of the words of many texts at once: words as exact fixed-width keys of a table held in numpy arrays.

A text is bytes, a word a range of them. The first bytes of a word and its length fill three 64-bit lanes, which
are the word itself, not a hash of it, so a word that is found is the right one. Words too long for the lanes are
encoded anew for each batch. No word that is known becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .hashing import mix

LANES = 3
LONGEST = 8 * LANES - 1  # bytes; the last byte of the lanes holds the length
SLOTS = 1 << 20
KEPT_WORDS = SLOTS * 5 // 9
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


def lanes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of LANES numbers, one per word of at most LONGEST bytes; ``data`` ends in 8 * LANES spare bytes."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = np.empty((len(starts), LANES), dtype=np.uint64)
    for k in range(LANES):
        out[:, k] = words[starts + 8 * k] & _MASK[np.clip(sizes - 8 * k, 0, 8)]
    out[:, -1] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


def gather(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``pool[first : first + size]`` one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordTable:
    """Ids by word. ``encode`` gives the ids of a list of words (UTF-8 bytes) as one array and their counts.

    Holds up to KEPT_WORDS words and starts anew beyond that, which costs time but changes no id.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], slots: int = SLOTS):
        self.encode, self.slots, self.most = encode, slots, slots * 5 // 9
        self._clear()

    def _clear(self) -> None:
        self.rows = np.zeros((self.slots, LANES + 1), dtype=np.uint64)  # lanes; place in the pool and number of ids
        self.pool = np.empty(1 << 16, dtype=np.uint32)
        self.held = self.used = 0

    def _probe(self, keys: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys and which of them are unknown."""
        values, unknown = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        while len(left):
            rows = self.rows[slot]
            hit = rows[:, 0] == keys[:, 0]
            for k in range(1, LANES):
                hit &= rows[:, k] == keys[:, k]
            values[left[hit]] = rows[hit, LANES]
            free = rows[:, LANES - 1] == 0  # a word has a length, so its last lane is not zero
            unknown[left[free]] = True
            on = ~(hit | free)
            left, slot, keys = left[on], (slot[on] + 1) & (self.slots - 1), keys[on]
        return values, unknown

    def _insert(self, keys: np.ndarray, slot: np.ndarray, values: np.ndarray) -> None:
        while len(slot):
            free = np.flatnonzero(self.rows[slot, LANES - 1] == 0)
            _, first = np.unique(slot[free], return_index=True)
            mine = free[first]
            self.rows[slot[mine], :LANES] = keys[mine]
            self.rows[slot[mine], LANES] = values[mine]
            on = np.ones(len(slot), dtype=bool)
            on[mine] = False
            keys, values, slot = keys[on], values[on], (slot[on] + 1) & (self.slots - 1)

    def _learn(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Encode distinct words and keep them; their values."""
        if self.held + len(starts) > self.most:
            self._clear()
        ids, counts = self.encode([data[s : s + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist())])
        if self.used + len(ids) > len(self.pool):
            grown = np.empty(max(2 * len(self.pool), self.used + len(ids)), dtype=np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        values = (self.used + np.cumsum(counts) - counts).astype(np.uint64) << np.uint64(16) | counts.astype(np.uint64)
        self._insert(keys, slot, values)
        self.held, self.used = self.held + len(starts), self.used + len(ids)
        return values

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        parts = []
        for at in range(0, max(len(starts), 1), self.most):  # never more distinct words at once than are kept
            parts.append(self._some(data, starts[at : at + self.most], sizes[at : at + self.most]))
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))

    def _some(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = np.flatnonzero(sizes > LONGEST)
        if len(long):
            return self._with_long(data, starts, sizes, long)
        keys = lanes(data, starts, sizes)
        codes = keys[:, 0] * _ODD[0]
        for k in range(1, LANES):
            codes += keys[:, k] * _ODD[k]
        slot = (mix(codes) >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        values, unknown = self._probe(keys, slot)
        new = np.flatnonzero(unknown)
        if len(new):
            whole = np.ascontiguousarray(keys[new]).view(np.dtype((np.void, 8 * LANES))).reshape(-1)
            _, first, place = np.unique(whole, return_index=True, return_inverse=True)
            some = new[first]
            if self.held + len(some) > self.most:  # what was found is forgotten too
                self._clear()
                return self._some(data, starts, sizes)
            values[new] = self._learn(data, starts[some], sizes[some], keys[some], slot[some])[place.reshape(-1)]
        counts = (values & np.uint64(0xFFFF)).astype(np.int64)
        return gather(self.pool, (values >> np.uint64(16)).astype(np.int64), counts), counts

    def _with_long(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Long words are encoded here and now, each distinct one once, and put between the others."""
        short = np.flatnonzero(sizes <= LONGEST)
        words = [data[s : s + n].tobytes() for s, n in zip(starts[long].tolist(), sizes[long].tolist())]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        long_ids, long_counts = self.encode(list(number))
        of = np.array([number[w] for w in words], dtype=np.int64)
        short_ids, short_counts = self._some(data, starts[short], sizes[short])
        pool = np.concatenate([short_ids, long_ids])
        first, counts = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
        first[short], counts[short] = np.cumsum(short_counts) - short_counts, short_counts
        first[long], counts[long] = len(short_ids) + (np.cumsum(long_counts) - long_counts)[of], long_counts[of]
        return gather(pool, first, counts), counts


def joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a zero byte after each and spare bytes at the end; and where each text begins (one more)."""
    data = np.frombuffer(b"\0".join([*texts, bytes(8 * LANES)]), dtype=np.uint8)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return data, bounds


def by_text(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = 4 * ends[np.searchsorted(starts, bounds)]
    raw = ids.astype("<u4", copy=False).tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
