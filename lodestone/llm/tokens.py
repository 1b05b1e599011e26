"""Token ids of whole texts with a public tokenizer, with a bounded cache of pre-token runs.

The byte-level pattern never joins a blank run to what precedes it, so a text may be cut before each blank
run and the pieces encoded apart; their ids join to those of the whole text. Words recur, so most
pieces are met in the cache. Texts with characters on which Python's and the tokenizer's idea of a blank
differ are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from . import words

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A word of Latin letters with the blank before it; a line end before such a word; else what follows up to
#: the next blank run. Each begins and ends where the tokenizer's own pattern does.
PIECE = re.compile(rf" ?[{_L}]++(?![^\W\d_])|\n(?=[{_L}])|\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: Entries of one of a worker's two cache generations, the longest piece that is kept, and bytes of the marks of pieces met once.
CACHE_ENTRIES, CACHE_CHARS, MARKS = 200_000, 64, 1 << 21


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype`` (16-bit where the vocabulary allows it)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}  # what was used lately
        self.older: dict[str, bytes] = {}
        self.met = bytearray(MARKS)
        self.kind = "H" if self.dtype.itemsize == 2 else "I"

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [array(self.kind, e.ids).tobytes() for e in found]

    def pieces(self, text: str) -> list[str] | None:
        """What ``text`` may be cut into; None if it must be encoded whole."""
        return None if _ODD.search(text) else PIECE.findall(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = self.pieces(text)
        if pieces is None:
            return self._encode([text])[0]
        return b"".join(self.encode_pieces(pieces))

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, pieces))
        if None not in found:
            return found
        cache, older, met = self.cache, self.older, self.met
        missing = dict.fromkeys(p for p, ids in zip(pieces, found, strict=True) if ids is None)
        for p in missing:
            missing[p] = older.get(p)
        new = [p for p, ids in missing.items() if ids is None]
        if new:
            missing.update(zip(new, self._encode(new), strict=True))
        if len(cache) > CACHE_ENTRIES:
            self.older, self.cache = cache, {}
            cache = self.cache
            met[:] = bytes(MARKS)
        for p, ids in missing.items():
            # Most distinct pieces never come again: a piece is kept from the second time on.
            mark = hash(p) % MARKS
            if met[mark] and len(p) <= CACHE_CHARS:
                cache[p] = ids
            else:
                met[mark] = 1
        return [missing[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]


# --- whole batches ---------------------------------------------------------------------------------------

_BLANK = ~words.BLANKS
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)  # printable ASCII but letters
_MARK[0x21:0x7F] = True
_MARK &= ~_ASCII
_LATIN = np.zeros(256, bool)  # second bytes of Latin letters after 0xC3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin: at texts, at blank runs, between a Latin letter and an ASCII mark or digit, and
    between a single line end and a letter. At none of these places does the tokenizer's pattern go on."""
    n = len(data)
    start = np.zeros(n, bool)
    start[at[:-1][at[:-1] < n]] = True
    if n < 2:
        return start
    blank, letter = _BLANK[data], _ASCII[data]
    after_c3 = np.zeros(n, bool)
    after_c3[1:] = data[:-1] == 0xC3
    ends_letter = letter | (after_c3 & _LATIN[data])
    start[1:] |= blank[1:] & ~blank[:-1]
    start[1:] |= ends_letter[:-1] & _MARK[data[1:]]
    start[2:] |= letter[2:] & (data[1:-1] == 0x0A) & ~blank[:-2]
    return start


def odd_texts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts to be encoded whole: with other than ASCII blanks, separators below them, or what may be a special token."""
    two = np.zeros((2, len(data)), np.uint8)  # what follows each byte
    two[0, :-1], two[1, :-2] = data[1:], data[2:]
    b, c, d = data, two[0], two[1]
    hit = (b >= 0x1C) & (b <= 0x1F)
    hit |= (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    high = np.flatnonzero((b >= 0xE1) & (b <= 0xE3) | (b == 0xEF))
    if len(high):
        b, c, d = b[high], c[high], d[high]
        rare = (b == 0xE1) | (b == 0xEF)
        rare |= (b == 0xE2) & ((c == 0x80) & ((d <= 0x8B) | (d == 0xA8) | (d == 0xA9) | (d == 0xAF)) | (c == 0x81) & (d == 0x9F))
        rare |= (b == 0xE3) & (c == 0x80) & (d == 0x80)
        hit[high] |= rare
    hit[:-1] |= (data[:-1] == 0x3C) & (two[0, :-1] == 0x7C)
    return np.unique(np.searchsorted(at, np.flatnonzero(hit), side="right") - 1)


class BatchEncoder:
    """Ids of whole Arrow arrays of texts. The cache is an open hash table in numpy: two independent 64-bit hashes of a piece's bytes
    as the key, and the piece's ids in one flat array. When it is full, pieces that were met again stay, the others go."""

    SLOTS, MAX_PIECE, PROBES = 1 << 20, 64, 32
    SHIFT = words.U(64 - 20)
    #: Pieces that the tokenizer gets at once: what it gives for each takes far more memory than the ids.
    AT_ONCE = 1 << 12

    def __init__(self, path: str):
        self.one = Encoder(path)
        self.dtype = self.one.dtype
        self._clear()

    def _clear(self) -> None:
        self.key1, self.key2 = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.entry = np.zeros(self.SLOTS, np.int32)
        self.begin, self.count, self.again = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.flat = np.zeros(0, self.dtype)

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        at = (h1 >> self.SHIFT).astype(np.int64)
        for _ in range(self.PROBES):
            k = self.key1[at]
            hit = (k == h1[todo]) & (self.key2[at] == h2[todo])
            out[todo[hit]] = self.entry[at[hit]]
            on = ~hit & (k != 0)
            if not on.any():
                break
            todo, at = todo[on], (at[on] + 1) & (self.SLOTS - 1)
        return out

    def _place(self, h1: np.ndarray, h2: np.ndarray, entry: np.ndarray) -> None:
        """Put keys into free slots; one that finds none within the probes is just not kept."""
        at = (h1 >> self.SHIFT).astype(np.int64)
        todo = np.arange(len(h1))
        for _ in range(self.PROBES):
            free = self.key1[at] == 0
            slot, win = np.unique(at[free], return_index=True)
            who = todo[free][win]
            self.key1[slot], self.key2[slot], self.entry[slot] = h1[who], h2[who], entry[who]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[win]] = False
            todo, at = todo[left], (at[left] + 1) & (self.SLOTS - 1)
            if not len(todo):
                return

    def _shrink(self) -> None:
        used = np.flatnonzero((self.key1 != 0) & self.again[self.entry])
        if len(used) > self.SLOTS // 3:
            used = used[: self.SLOTS // 3]
        h1, h2, old = self.key1[used], self.key2[used], self.entry[used]
        begin, count, flat = self.begin[old], self.count[old], self.flat
        self._clear()
        self.flat = flat[words.ranges(begin, count)]
        self.count = count
        self.begin = np.cumsum(count) - count
        self.again = np.zeros(len(count), bool)
        self._place(h1, h2, np.arange(len(count), dtype=np.int32))

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Entries of new pieces."""
        flat, counts = [self.flat], [np.zeros(0, np.int32)]
        for i in range(0, len(pieces), self.AT_ONCE):
            found = self.one.tokenizer.encode_batch([p.decode() for p in pieces[i : i + self.AT_ONCE]], add_special_tokens=False)
            ids = [e.ids for e in found]
            counts.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), self.dtype, int(counts[-1].sum())))
        base, count = len(self.begin), np.concatenate(counts)
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate(flat)
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])
        return np.arange(base, base + len(pieces), dtype=np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more place than texts)."""
        data, at = words.buffers(texts)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        start = piece_starts(data, at)
        for d in odd_texts(data, at).tolist():
            start[at[d] + 1 : at[d + 1]] = False
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        w = words.Words(data, at, begin, end, np.searchsorted(begin, at))
        size = end - begin
        h1 = w.hashes()
        h1[h1 == 0] = 1
        h2 = words.mix(w.hashes(words.K2) ^ h1)
        if len(self.begin) > self.SLOTS // 2:
            self._shrink()
        entry = self._find(h1, h2)
        known = entry >= 0
        self.again[entry[known]] = True
        new = np.flatnonzero(~known)
        raw = data.tobytes() if len(new) else b""
        if len(new):
            short = new[size[new] <= self.MAX_PIECE]
            _, head, inverse = np.unique(h1[short], return_index=True, return_inverse=True)
            lead = short[head]
            if len(lead):
                added = self._add([raw[a:b] for a, b in zip(begin[lead].tolist(), end[lead].tolist(), strict=True)])
                entry[short] = added[inverse]
                self.again[added] = np.bincount(inverse) > 1
                self._place(h1[lead], h2[lead], added)
        keep = len(self.begin), len(self.flat)
        long = new[size[new] > self.MAX_PIECE]
        if len(long):
            entry[long] = self._add([raw[a:b] for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)])
        count = self.count[entry].astype(np.int64)
        ids = self.flat[words.ranges(self.begin[entry], count)]
        if len(long):  # not to be kept
            self.begin, self.count, self.again, self.flat = self.begin[: keep[0]], self.count[: keep[0]], self.again[: keep[0]], self.flat[: keep[1]]
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[w.first]


def batch_encoder(path: str) -> BatchEncoder:
    """One for each worker process, as long as it works on token ids."""
    if path not in words.caches:
        words.caches[path] = BatchEncoder(path)
    return words.caches[path]


def encoder(path: str) -> Encoder:
    """The same for single texts."""
    key = ("single", path)
    if key not in words.caches:
        words.caches[key] = Encoder(path)
    return words.caches[key]
