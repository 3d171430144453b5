"""Minimal perfect hashing of a set of 64-bit keys.

Every key is hashed to a bit of a vector twice as long as the keys; keys alone
on their bit stay there, the others go on to the next, smaller vector with
another seed, until none is left. A key's number is the rank of its bit in
all vectors: n keys get the numbers 0 to n - 1, at about four bits a key.
"""

from __future__ import annotations

import numpy as np

# fixed values: multipliers of a published 64-bit mixing function (splitmix64)
_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys + _STEP * np.uint64(level + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        return (z ^ (z >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """`levels` are the bits of each vector."""
        self.levels, self.ranks, before = levels, [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + before)
            before += int(bits.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        """Of distinct keys; two equal keys would never part, so they are an error."""
        left = np.asarray(keys).astype(np.uint64)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        levels = []
        while len(left):
            size = max(64, int(room * len(left)))
            slots = _slots(left, len(levels), size)
            alone = np.bincount(slots.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            left = left[~alone[slots]]
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; a key that was not among those built from gets any number or -1, so verify it."""
        keys = np.asarray(keys).astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            slots = _slots(keys[open_], level, len(bits))
            here = bits[slots]
            out[open_[here]] = ranks[slots[here]]
            open_ = open_[~here]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.asarray([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        count = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", count, 4), 4 * (count + 1), []
        for size in map(int, sizes):
            packed = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, packed, at), count=size).astype(bool))
            at += packed
        return cls(levels)
