"""Minimal perfect hashing of 64-bit keys: n distinct keys to the numbers 0 to n - 1 in a few bits a key.

Level by level every key hashes to a place of a bit array twice as long as there are keys; a key alone at its place sets
the bit, the others go on to the next level.  The number of a key is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

from parley.llm.common import mixed

LEVELS = 40
ROOM = 2  # bits of a level for each key


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys ^ mixed(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)


class MinimalHash:
    """``sizes`` bits of each level, ``words`` all levels' bits, ``rest`` what no level has parted (hardly ever any)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.cumsum(sizes) - sizes
        self.before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
        self.placed = int(np.bitwise_count(words).sum(dtype=np.int64))

    @classmethod
    def of(cls, keys: np.ndarray) -> MinimalHash:
        """For distinct keys."""
        sizes, bits, rest = [], [], keys.astype(np.uint64)
        while len(rest) and len(sizes) < LEVELS:
            size = -(-ROOM * len(rest) // 64) * 64
            at = _place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[at]]
        packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), packed.view("<u8"), np.sort(rest))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not among those hashed any number, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            at = _place(keys[left], level, size) + self.first[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.placed + at[hit]
        return out

    def blocks(self) -> list:
        """Buffers for a file; ``read`` takes them back."""
        head = np.array([len(self.sizes), len(self.words), len(self.rest)], "<i8")
        return [head, self.sizes.astype("<i8"), np.ascontiguousarray(self.words, "<u8"), self.rest.astype("<u8")]

    @classmethod
    def read(cls, data: np.ndarray) -> tuple[MinimalHash, int]:
        """From the bytes of a file that begins with ``blocks``; also the number of bytes they take."""
        levels, words, rest = (int(x) for x in data[:24].view("<i8"))
        ends = np.cumsum([24, 8 * levels, 8 * words, 8 * rest])
        parts = [data[a:b].view(kind) for a, b, kind in zip(ends[:-1], ends[1:], ("<i8", "<u8", "<u8"))]
        return cls(*parts), int(ends[-1])
