"""Words and rolling hashes of whole Arrow batches, in numpy.

A word is a run of word bytes inside one text; both alphabets used here are closed under UTF-8, as every
byte of a multi-byte character counts as a word byte. Nothing loops over words except those over 64 bytes.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: ``[^\x20\x09-\x0D]+``
BLANKS = np.ones(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U = np.uint64
K0, K1, K2, K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
_TAIL = np.array([0] + [(1 << (8 * n)) - 1 for n in range(1, 8)] + [2**64 - 1], dtype=np.uint64)
#: Texts are taken in groups of so many bytes, for bounded memory.
GROUP_BYTES = 2 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not glibc
    _trim = None


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside other workers and the JVM."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the result depends on every bit given."""
    h = (h ^ (h >> U(30))) * K1
    h = (h ^ (h >> U(27))) * K2
    return h ^ (h >> U(31))


@dataclass
class Words:
    """Words of a group of texts. Word ``i`` is ``data[start[i]:end[i]]``; text ``d`` has the words
    ``first[d]`` to ``first[d + 1]``; ``text_at[d]`` is where text ``d`` begins in ``data``."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, factor: np.uint64 = K1) -> np.ndarray:
        """A 64-bit hash of each word's bytes; another odd ``factor`` gives another hash."""
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(self.data) + 1,), strides=(1,))
        h = size.astype(np.uint64) * K0
        at, left, todo = self.start, size, None
        for _ in range(8):
            val = eights[at] & _TAIL[np.minimum(left, 8)]
            if todo is None:
                h = (h ^ val) * factor
                h ^= h >> U(32)
            else:
                x = (h[todo] ^ val) * factor
                h[todo] = x ^ (x >> U(32))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            todo = more if todo is None else todo[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > 64):
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), int(factor))
        return mix(h)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of ``begin[i] .. begin[i] + count[i] - 1``, joined."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(begin - (np.cumsum(count) - count), count)


def spaced(w: Words) -> tuple[bytes, np.ndarray]:
    """The words of a group joined by single spaces, and where each begins: runs of equal words are equal bytes there."""
    size = w.end - w.start
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at + size] = False
    out[inside] = w.data[ranges(w.start, size)]
    return out.tobytes(), at


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array, and where each text begins; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


#: What a worker keeps from task to task for one operator; the tasks of other operators drop it.
caches: dict = {}


def groups(batch: pa.RecordBatch, column: str = "text", size: int = GROUP_BYTES, keep_caches: bool = False):
    """Slices of a batch whose texts hold about ``size`` bytes each (one text at least)."""
    if not keep_caches:
        caches.clear()
    _, at = buffers(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
    release()


def split(texts: pa.Array, alphabet: np.ndarray = BLANKS, lower: bool = False) -> Words:
    data, at = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64))
    inside = alphabet[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(data, at, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values, mixed; shorter input has none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= K3
        out += h[j : j + m]
    return mix(out)


def whole(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each run of ``n`` consecutive words of a group, whether it lies within one text."""
    m = total - n + 1
    ok = np.ones(max(m, 0), bool)
    if m > 0:
        ends = first[1:]
        for j in range(1, n):
            x = ends - j
            ok[x[(x >= 0) & (x < m)]] = False
    return ok


def cover(marks: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``n`` that starts at one of ``marks``."""
    d = np.zeros(total + 1, np.int64)
    np.add.at(d, marks, 1)
    np.subtract.at(d, np.minimum(marks + n, total), 1)
    return np.cumsum(d[:-1]) > 0
