"""Minimal perfect hash over 32-byte digests, built and queried with whole-array operations.

Levels of bit arrays: at each level every remaining key hashes to one bit, keys that are alone on
their bit settle there, the others go to the next level. A key's slot is the rank of its bit over all
levels, so n keys fill the slots 0..n-1 exactly.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.7  # bits a key at each level
LEVELS = 48


def as_matrix(digests) -> np.ndarray:
    """Digests (32 bytes each) as an n x 32 array of bytes."""
    joined = b"".join(digests)
    return np.frombuffer(joined, np.uint8).reshape(-1, 32)


def _bit(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = np.ascontiguousarray(keys).view(np.uint64)
    return words[:, 0].copy(), words[:, 1].copy()


class MinimalPerfectHash:
    """sizes: bits of each level; bits: the levels one after another; n: keys settled in them."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.n = int(self.rank[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: n x 32 bytes, all different. Keys with equal first halves cannot be told apart by the
        levels and stay out; slots() then gives them -1 (two SHA-256 digests would have to share 128 bits)."""
        a, b = _halves(keys)
        sizes, levels = [], []
        for level in range(LEVELS):
            if not len(a):
                break
            size = max(8, int(GAMMA * len(a)))
            at = _bit(a, b, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            stay = ~alone[at]
            a, b = a[stay], b[stay]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that is no member, some slot or -1: compare the full key there."""
        a, b = _halves(keys)
        out, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + _bit(a[left], b[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + size
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = [int(x) for x in np.frombuffer(data, np.int64, n, 8)]
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)), count=sum(sizes)).astype(bool)
        return cls(sizes, bits)
