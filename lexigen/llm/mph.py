"""A minimal perfect hash over 64-bit keys, with arrays it indexes.

Level by level, the keys that are alone in their cell of a bit array are settled there and
the others go on to the next level; a settled key's index is the number of set bits before it.
"""

from __future__ import annotations

import io

import numpy as np

from lexigen.llm.common import mix64


def _cells(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (mix64(keys ^ salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``index(keys)``: a number in 0..n-1, one for each of the n keys; of other keys any
    number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.first = np.concatenate([[0], np.cumsum(-(-sizes // 64))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> "PerfectHash":
        """``keys``: distinct uint64."""
        sizes, words = [], []
        rest = keys
        while len(rest):
            size = max(64, int(gamma * len(rest)))
            cell = _cells(rest, len(sizes), size)
            alone = np.bincount(cell, minlength=size) == 1
            packed = np.zeros(-(-size // 64) * 64, np.uint8)
            packed[:size] = alone
            words.append(np.packbits(packed, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = rest[~alone[cell]]
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))[:-1]]) if len(bits) else np.zeros(0)
        return cls(np.array(sizes, np.int64), bits, ranks.astype(np.uint32))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            cell = _cells(keys[live], level, int(size))
            word = self.first[level] + (cell >> 6)
            bit = (cell & 63).astype(np.uint64)
            hit = ((self.bits[word] >> bit) & np.uint64(1)).astype(bool)
            below = self.bits[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[live[hit]] = self.ranks[word[hit]].astype(np.int64) + np.bitwise_count(below)
            live = live[~hit]
        return out


class CountShard:
    """Counts of 128-bit line hashes (h1, h2): h1 through the perfect hash, h2 as the
    fingerprint. Pairs whose h1 is taken by another h2 stand in a short exact list."""

    FIELDS = ("sizes", "bits", "ranks", "prints", "counts", "more1", "more2", "more_counts")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.hash = PerfectHash(self.sizes, self.bits, self.ranks)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray) -> "CountShard":
        _, first = np.unique(h1, return_index=True)
        other = np.setdiff1d(np.arange(len(h1)), first)
        mph = PerfectHash.build(h1[first])
        at = mph.index(h1[first])
        prints, held = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint32)
        prints[at] = h2[first]
        held[at] = np.minimum(counts[first], 0xFFFFFFFF)
        return cls(sizes=mph.sizes, bits=mph.bits, ranks=mph.ranks, prints=prints, counts=held, more1=h1[other], more2=h2[other], more_counts=counts[other])

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Counts of the hash pairs, 0 for those not stored."""
        out = np.zeros(len(h1), np.int64)
        if not len(self.prints):
            return out
        at = self.hash.index(h1)
        same = (at >= 0) & (self.prints[at] == h2)
        out[same] = self.counts[at[same]]
        for a, b, n in zip(self.more1, self.more2, self.more_counts, strict=True):
            out[(h1 == a) & (h2 == b)] = n
        return out

    def to_bytes(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{k: getattr(self, k) for k in self.FIELDS})
        return f.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountShard":
        with np.load(io.BytesIO(raw)) as f:
            return cls(**{k: f[k] for k in cls.FIELDS})
