"""Quality rules by repetition coverage (operator 5).

A map over the documents. Hashes of word windows, in numpy, roll from one n-gram length to the next and mark every window of
n words that occurs twice or more in its text; the measure is the share of the text's word characters
that lie inside marked windows. Lines are measured alike: the share of word characters in lines equal to
an earlier line. A text is kept if no measure is above its limit.

Defined cases: null and empty texts have no words and fail the base rule; null ids pass through; repeated
rows are judged one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import plain_names

#: n-gram length and the largest share of word characters inside repeated n-grams of that length.
NGRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest shares of lines, and of word characters in lines, equal to an earlier line.
DUP_LINE_LIMIT, DUP_LINE_CHAR_LIMIT = 0.30, 0.20
#: Largest number of symbols for each word.
SYMBOL_LIMIT = 0.10
MIN_WORDS, BASE_N = 10, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, dup_line_chars double, max_ngram_excess double"
)


def repeated(h: np.ndarray, ok: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which windows equal another window of the same text; ``h`` has a hash and ``doc`` a text for each."""
    at = np.flatnonzero(ok)
    key = h[at] ^ words.mix(doc[at].astype(np.uint64) + words.U(1))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return at[hit]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _dup_lines(text: str | None) -> tuple[int, int, int]:
    """Lines with a word; those equal to an earlier one; the word characters in the latter."""
    if not text:
        return 0, 0, 0
    seen: set[str | bytes] = set()
    n = dup = chars = 0
    for line in text.split("\n"):
        if not line.strip(" \t\r\x0b\x0c"):
            continue
        n += 1
        key = line if len(line) < 64 else xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
        if key in seen:
            dup += 1
            chars += len(line.translate(_NO_BLANKS))
        else:
            seen.add(key)
    return n, dup, chars


_NO_BLANKS = {c: None for c in (0x20, *range(0x09, 0x0E))}


def measure(group: pa.RecordBatch) -> dict[str, np.ndarray]:
    """All measures of a group of texts."""
    w = words.split(group.column("text"))
    n = w.counts
    lead = (w.data & 0xC0) != 0x80  # first bytes of code points
    points = np.concatenate([[0], np.cumsum(lead)])
    size = points[w.end] - points[w.start]
    doc, h = w.doc_of(), w.hashes()
    out = {"n_words": n, "word_chars": _sums(size, w.first), "n_symbols": _sums(_SYMBOL[w.data], w.text_at)}
    chars = np.maximum(out["word_chars"], 1)
    excess = np.full(len(n), -1.0)
    repeats = np.zeros(len(n), np.int64)
    open_docs = np.ones(len(n), bool)
    # The hash of k words rolls on to that of k + 1: one multiplication and one addition a place.
    rolled, width = h.copy(), 1
    for k in sorted({BASE_N, *NGRAM_LIMITS}):
        while width < k:
            rolled *= words.K3
            rolled[:-width] += h[width:]
            width += 1
        first = np.searchsorted(doc, np.arange(len(n) + 1))
        ok = words.whole(first, k, len(h))
        marks = repeated(words.mix(rolled[: len(ok)]), ok, doc[: len(ok)])
        covered = words.cover(marks, k, len(h))
        if k == BASE_N:
            repeats = _sums(covered, first)
        if k in NGRAM_LIMITS:
            excess = np.maximum(excess, np.where(open_docs, _sums(covered * size, first) / chars - NGRAM_LIMITS[k], -1))
        # A repeated window of k + 1 words holds a repeated one of k, so texts without any are done.
        open_docs &= _sums(covered, first) > 0
        at = np.flatnonzero(open_docs[doc])
        h, doc, size, rolled = h[at], doc[at], size[at], rolled[at]
    lines = np.array([_dup_lines(t) for t in group.column("text").to_pylist()], np.int64).reshape(-1, 3)
    return out | {"n_lines": lines[:, 0], "n_dup_lines": lines[:, 1], "dup_line_chars": lines[:, 2] / chars, "n_repeat_words": repeats, "max_ngram_excess": excess}


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of a group's measures."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    bad = (m["max_ngram_excess"] > 0) | (m["n_dup_lines"] > DUP_LINE_LIMIT * m["n_lines"]) | (m["dup_line_chars"] > DUP_LINE_CHAR_LIMIT) | (m["n_symbols"] > SYMBOL_LIMIT * m["n_words"])
    return failed, ~failed & ~bad


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch):
                yield group.filter(pa.array(verdict(measure(group))[1]))

    rows = docs.toDF(*plain_names(docs.columns))
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document: see ``RESULT``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch):
                m = measure(group)
                failed, kept = verdict(m)
                longs = [pa.array(m[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [group.column("doc_id"), *longs, pa.array(failed), pa.array(kept), pa.array(m["n_lines"].astype(np.int64)), pa.array(m["dup_line_chars"]), pa.array(m["max_ngram_excess"])],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_chars", "max_ngram_excess"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, RESULT)
