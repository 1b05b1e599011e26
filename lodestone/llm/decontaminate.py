"""Benchmark decontamination over a distributed positional inverted index (operator 6).

``build_index`` stores the postings of the training texts, split by documents: each row of the index table
covers some megabytes of text and holds its sorted terms (64-bit hashes), and for each term the sorted
positions of its words in that row. ``search`` brings phrases (bounded blocks of them) to every row: per
phrase, the terms' posting lists are taken from the rarest on; the rarest list, adjusted by the term's offset,
gives candidate places, and each further list keeps those that it holds at its own offset. A phrase
with a term that the row lacks costs nothing. Places that cross a document's end are no matches.

No posting is shuffled, so a frequent term or a passage in very many documents loads no task more than
its own documents do. Phrases come in blocks of about ``BLOCK_CHARS`` characters of distinct items, of which longer ones are cut with an overlap; each block is a pass of its own
over the index, and results of all blocks are merged by document. The postings table has no stop list.

Defined cases: null texts have no words; items without words have no windows; an item of fewer than
``WINDOW`` words is one window; null item ids are listed as ``null``; repeated item ids count once, and
every text under them counts; null doc_ids pass through; repeated rows are judged one by one; empty tables on
either side are legal; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import materialise, scratch

WINDOW = 13
#: A document is contaminated if this share of its words is hit: 20 * n_hit >= n_words.
MIN_SHARE = 20
ROW_BYTES = 4 << 20
BLOCK_CHARS = 4_000_000
CANDIDATES = 1 << 20
INDEX = "row long, doc_ids array<long>, text_keys array<long>, first binary, terms binary, ends binary, postings binary"
FOUND = "row long, doc_no int, doc_id long, text_key long, n_words long, starts array<int>, lengths array<int>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, text_key long"


def _planes(x: np.ndarray) -> bytes:
    """32-bit values as four planes of bytes: the high ones are mostly zero and compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def text_key(text: Column) -> Column:
    """What tells apart rows that share an id."""
    return F.xxhash64(text.cast("string"))


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all ``docs`` as a table: see ``INDEX``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for group in words.groups(batch, size=ROW_BYTES):
                w = words.split(group.column("text"), words.ALNUM, lower=True)
                h = w.hashes()
                order = np.argsort(h, kind="stable")
                terms, begin = np.unique(h[order], return_index=True)
                steps = np.diff(order, prepend=0)
                steps[begin] = order[begin]  # each list begins with a position and goes on with distances
                ends = np.append(begin[1:], len(h))[: len(begin)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row], pa.int64()), pa.array([group.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([group.column("text_key").to_pylist()], pa.list_(pa.int64())),
                        *(pa.array([x], pa.binary()) for x in (_planes(w.first), terms.tobytes(), _planes(ends), _planes(steps))),
                    ],
                    names=["row", "doc_ids", "text_keys", "first", "terms", "ends", "postings"],
                )
                row += 1

    return materialise(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", text_key(F.col("text"))).mapInArrow(build, INDEX), "postings")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time, as each holds megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]
    words.release()


class Postings:
    """One row of the index: lists of the terms asked for."""

    def __init__(self, first: bytes, terms: bytes, ends: bytes, postings: bytes, asked: np.ndarray):
        self.first = _unplanes(first)
        own, ends_, steps = np.frombuffer(terms, np.uint64), _unplanes(ends), _unplanes(postings)
        self.n = len(steps)
        at = np.minimum(np.searchsorted(own, asked), max(len(own) - 1, 0))
        there = np.flatnonzero(own[at] == asked) if len(own) else np.zeros(0, np.int64)
        begin = np.concatenate([[0], ends_[:-1]]) if len(ends_) else ends_
        self.count = np.zeros(len(asked) + 1, np.int64)
        self.count[there] = ends_[at[there]] - begin[at[there]]
        self.list_at = np.concatenate([[0], np.cumsum(self.count)])
        pick = words.ranges(begin[at[there]], self.count[there])
        term = np.repeat(there, self.count[there])
        values = steps[pick]
        total = np.cumsum(values)
        heads = self.list_at[there]
        base = np.concatenate([[0], total])[heads]
        self.positions = total - np.repeat(base, self.count[there])
        self.term_at = np.full(self.n, -1, np.int32)
        self.term_at[self.positions] = term


def occurrences(p: Postings, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of each occurrence. ``phrases``: term numbers, a row each, the number past the last as padding."""
    width = phrases.shape[1]
    pad = np.arange(width)[None, :] >= size[:, None]
    counts = np.where(pad, np.iinfo(np.int64).max, p.count[phrases])
    alive = np.flatnonzero(counts.min(axis=1) > 0)
    out_a, out_b = [], []
    order = np.argsort(counts[alive], axis=1, kind="stable")
    rarest = counts[alive, order[:, 0]]
    cuts = np.searchsorted(np.cumsum(rarest), np.arange(CANDIDATES, int(rarest.sum()) + CANDIDATES, CANDIDATES)) if len(alive) else []
    begin = 0
    for end in [*np.minimum(np.asarray(cuts, np.int64) + 1, len(alive))]:
        if end <= begin:
            continue
        a, o = alive[begin:end], order[begin:end]
        lead = phrases[a, o[:, 0]]
        which = np.repeat(np.arange(len(a)), p.count[lead])
        place = p.positions[words.ranges(p.list_at[lead], p.count[lead])] - o[which, 0]
        doc = np.searchsorted(p.first, np.maximum(place, 0), side="right") - 1
        ok = (place >= 0) & (place >= p.first[doc]) & (place + size[a[which]] <= p.first[np.minimum(doc + 1, len(p.first) - 1)])
        which, place = which[ok], place[ok]
        for j in range(1, width):
            off = o[which, j]
            same = off >= size[a[which]]
            at = np.minimum(place + off, max(p.n - 1, 0))
            same |= p.term_at[at] == phrases[a[which], off]
            which, place = which[same], place[same]
            if not len(which):
                break
        out_a.append(a[which])
        out_b.append(place)
        begin = end
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _windows(items: list[tuple[str, str | None]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Sorted distinct terms, phrases as term numbers, their sizes and item names."""
    w = words.split(pa.array([t for _, t in items], pa.large_string()), words.ALNUM, lower=True)
    terms, number = np.unique(w.hashes(), return_inverse=True)
    rows, size, name = [], [], []
    for i, (item, _) in enumerate(items):
        own = number[w.first[i] : w.first[i + 1]]
        if len(own) >= window:
            rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
        elif len(own):
            rows.append(np.append(own, np.full(window - len(own), len(terms)))[None, :])
        else:
            continue
        size += [min(len(own), window)] * len(rows[-1])
        name += [item] * len(rows[-1])
    table = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
    code = {n: i for i, n in enumerate(dict.fromkeys(name))}
    _, keep = np.unique(np.column_stack([table, [code[n] for n in name]]), axis=0, return_index=True) if rows else (None, np.zeros(0, np.int64))
    return terms, table[keep], np.array(size, np.int64)[keep], [name[i] for i in keep]


def search(index: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW, every: bool = True) -> DataFrame:
    """Exact occurrences of all windows of ``items`` (name, text), one bounded block: see ``FOUND``.

    With ``every``, documents without any occurrence have a row too.
    """
    spark = index.sparkSession
    given = spark.sparkContext.broadcast(_windows(items, window))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, phrases, size, name = given.value
        names = np.array(name, object)
        for batch in batches:
            for r in _rows(batch):
                p = Postings(r["first"], r["terms"], r["ends"], r["postings"], terms)
                which, place = occurrences(p, phrases, size)
                doc = np.searchsorted(p.first, place, side="right") - 1
                # The last document that begins at or before a place is never an empty one.
                order = np.lexsort((place, doc))
                which, place, doc = which[order], place[order], doc[order]
                n = len(p.first) - 1
                cut = np.searchsorted(doc, np.arange(n + 1))
                keep = np.arange(n) if every else np.flatnonzero(np.diff(cut))
                starts, lengths, found = [], [], []
                for d in keep:
                    s = slice(cut[d], cut[d + 1])
                    span = np.unique(np.column_stack([place[s] - p.first[d], size[which[s]]]), axis=0) if cut[d + 1] > cut[d] else np.zeros((0, 2), np.int64)
                    starts.append(span[:, 0].tolist())
                    lengths.append(span[:, 1].tolist())
                    found.append(sorted(set(names[which[s]])))
                ids, texts = r["doc_ids"], r["text_keys"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["row"]] * len(keep), pa.int64()), pa.array(keep, pa.int32()), pa.array([ids[d] for d in keep], pa.int64()), pa.array([texts[d] for d in keep], pa.int64()),
                        pa.array(np.diff(p.first)[keep], pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())),
                    ],
                    names=["row", "doc_no", "doc_id", "text_key", "n_words", "starts", "lengths", "items"],
                )

    return index.mapInArrow(find, FOUND)


def proximity(index: DataFrame, terms: list[str], width: int) -> DataFrame:
    """(doc_id, start, span) of the shortest stretch from each place of the rarest term on or before it that
    holds all ``terms`` within ``width`` words, in any order; one row for each document: its tightest."""
    w = words.split(pa.array(terms, pa.large_string()), words.ALNUM, lower=True)
    asked = np.unique(w.hashes())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                p = Postings(r["first"], r["terms"], r["ends"], r["postings"], asked)
                if not len(asked) or not p.count[:-1].min():
                    continue
                # Every term's next place at or after a start; a tightest stretch begins at a place of some term.
                lists = [p.positions[p.list_at[i] : p.list_at[i + 1]] for i in range(len(asked))]
                start = np.unique(np.concatenate(lists))
                doc = np.searchsorted(p.first, start, side="right") - 1
                end = start.copy()
                for own in lists:
                    i = np.searchsorted(own, start)
                    end = np.maximum(end, np.append(own, np.iinfo(np.int64).max)[i])
                span = end - start + 1
                ok = (end < p.first[doc + 1]) & (span <= width)
                start, doc, span = start[ok], doc[ok], span[ok]
                order = np.lexsort((start, span, doc))
                _, head = np.unique(doc[order], return_index=True)
                best = order[head]
                ids = r["doc_ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[d] for d in doc[best]], pa.int64()), pa.array(start[best] - p.first[doc[best]], pa.int32()), pa.array(span[best], pa.int32())],
                    names=["doc_id", "start", "span"],
                )

    return index.mapInArrow(find, "doc_id long, start int, span int")


def _digest(found: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.array(batch.column("n_words").to_pylist(), np.int64)
            hits, items = [], []
            for starts, lengths, names in zip(*(batch.column(c).to_pylist() for c in ("starts", "lengths", "items")), strict=True):
                hit = last = 0
                for s, k in sorted(zip(starts, lengths, strict=True)):
                    hit += max(0, s + k - max(s, last))
                    last = max(last, s + k)
                hits.append(hit)
                items.append(sorted(set(names)))
            hit = np.array(hits, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_words"), pa.array(hit), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array((hit > 0) & (MIN_SHARE * hit >= n)), batch.column("text_key"),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "text_key"],
            )

    return found.mapInArrow(digest, RESULT)


def _pieces(window: int, block_chars: int):
    """Items of more than ``block_chars`` characters in pieces of about so many; each begins with the last ``window`` - 1 words of the one before, so the windows are the same."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None or len(text) <= block_chars:
                    out.append((item, text))
                    continue
                w = words.split(pa.array([text], pa.large_string()), words.ALNUM, lower=True)
                raw, n = w.data.tobytes(), len(w.start)
                step = max(window, n * block_chars // len(text))
                for i in range(0, max(n - window + 1, 1), step):
                    own = range(i, min(i + step + window - 1, n))
                    out.append((item, b" ".join(raw[w.start[j] : w.end[j]] for j in own).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["item", "text"])

    return cut


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Hits of benchmark windows in every document: see ``RESULT``; text_key is that of the function."""
    with scratch(docs.sparkSession):
        return materialise(_contamination(build_index(docs), benchmark, window, block_chars), "contamination", keep=True)


def _contamination(index: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string")).distinct()
    items = materialise(items.mapInArrow(_pieces(window, block_chars), "item string, text string"), "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    parts = []
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        parts.append(search(index, [(r["item"], r["text"]) for r in block.collect()], window, every=k == 0))
    if blocks == 1:
        return _digest(parts[0])
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    flat = [F.flatten(F.collect_list(F.struct("starts", "lengths", "items"))[c]).alias(c) for c in ("starts", "lengths", "items")]
    merged = found.groupBy("row", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), *flat)
    return _digest(merged.select(*parts[0].columns))
