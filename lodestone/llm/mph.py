"""A minimal perfect hash over 64-bit keys, with stored fingerprints, built and probed in numpy.

Level by level, keys are thrown into a bitmap of ``GAMMA`` bits a key; a key alone on its bit is settled
there, the others go on to the next level. A key's number is the rank of its bit over all levels, so n
keys get the numbers 0 to n - 1. After ``LEVELS`` levels the few keys left are kept sorted and numbered last. A
probe costs one bit test a level (two levels on average) and one rank read: constant time.
"""

from __future__ import annotations

import numpy as np

from .words import K3, U, mix

GAMMA, LEVELS = 2.0, 24
_MAGIC = np.uint64(0x314850_4D45444F4C)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + U((level + 1) * int(K3) % (1 << 64))) % U(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.ranks, self.rest = sizes, words, ranks, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n_bits = int(ranks[-1]) if len(ranks) else 0

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64."""
        sizes, bits, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-max(64, int(len(left) * GAMMA)) // 64) * 64
            at = _slot(left, level, size)
            count = np.bincount(at, minlength=size)
            alone = count[at] == 1
            sizes.append(size)
            bits.append(count == 1)
            left = left[~alone]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        words = np.packbits(flat, bitorder="little").view(np.uint64) if len(flat) else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, ranks, np.sort(left))

    def __len__(self) -> int:
        return self.n_bits + len(self.rest)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key. A key that was not built in gets -1 or any number: check its fingerprint."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = _slot(keys[todo], level, int(size)) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & U(1) == U(1)
            below = word & ((U(1) << bit) - U(1))
            out[todo[hit]] = (self.ranks[at >> 6] + np.bitwise_count(below))[hit]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[i] == keys[todo]
            out[todo[hit]] = self.n_bits + i[hit]
        return out

    # --- bytes ------------------------------------------------------------------------------------

    def to_bytes(self) -> bytes:
        head = np.array([_MAGIC, len(self.sizes), len(self.words), len(self.rest)], np.uint64)
        return b"".join(x.tobytes() for x in (head, self.sizes, self.words, self.ranks, self.rest))

    @classmethod
    def from_buffer(cls, buf) -> tuple[PerfectHash, int]:
        """The hash, and how many bytes of ``buf`` it takes; arrays stay views of ``buf``."""
        head = np.frombuffer(buf, np.uint64, 4)
        if head[0] != _MAGIC:
            raise ValueError("not a perfect hash")
        n, w, r = (int(x) for x in head[1:])
        at, out = 32, []
        for kind, count in ((np.int64, n), (np.uint64, w), (np.int64, w + 1), (np.uint64, r)):
            out.append(np.frombuffer(buf, kind, count, at))
            at += 8 * count
        return cls(*out), at


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits that do not depend on the slots."""
    return (mix(keys ^ U(0xA5A5A5A5_5A5A5A5A)) >> U(32)).astype(np.uint32)
