"""Best-fit packing of token sequences (operator 3).

Two steps. ``pieces`` is a map over the documents: it encodes each text, adds the end id, and cuts what is
longer than a sequence into pieces, the first one shorter. ``pack`` places pieces into sequences by
bounded-space online best-fit: a fixed number of bins is open; a bitset keyed by free space finds the
fullest bin that still fits in one shift and one lowest-bit test; if none fits and all are open, the
fullest one closes. Only lengths take part, never texts.

Packing runs in tasks of about ``rows_per_task`` pieces each, dealt out evenly whatever their ids. Within a task pieces arrive in the order of a hash, and a window
of twice ``open_bins`` pieces is looked ahead: its pieces are placed in falling length (ties by document and place). So large pieces begin bins that the small ones of the same
window fill, the memory of a task is bounded by the window and the open bins, and the loss against the least possible number of
sequences does not depend on the size of the input.

Defined cases: null and empty texts give one piece with the end id alone; null ids pack like others;
repeated rows are packed once each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import free_name, materialise
from .tokens import batch_encoder

MAX_LEN, END_ID, OPEN_BINS, ROWS_PER_TASK = 2048, 0, 1_024, 100_000
#: Texts are encoded in groups of so many bytes: an executor keeps workers of other stages, with their caches, beside those that run.
GROUP_BYTES = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def crc_u32(ids: np.ndarray, crc: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), crc)


def pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            for group in words.groups(batch, size=GROUP_BYTES, keep_caches=True):
                doc, piece, start, length, crc = [], [], [], [], []
                every, at = enc.encode(group.column("text"))
                for i, key in enumerate(group.column("doc_id").to_pylist()):
                    ids = np.concatenate([every[at[i] : at[i + 1]], end])
                    first = len(ids) % max_len or max_len
                    edges = [0, *range(first, len(ids) + 1, max_len)]
                    for j in range(len(edges) - 1):
                        doc.append(key)
                        piece.append(j)
                        start.append(edges[j])
                        length.append(edges[j + 1] - edges[j])
                        crc.append(crc_u32(ids[edges[j] : edges[j + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class Packer:
    """Bounded-space online best-fit. ``place(n)`` gives the bin's number and the place in it."""

    def __init__(self, capacity: int = MAX_LEN, open_bins: int = OPEN_BINS):
        self.capacity, self.limit, self.open, self.bins = capacity, open_bins, 0, 0
        self.free = 0  # bit f: some open bin has f free places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, f: int) -> int:
        found = self.by_free[f].pop()
        if not self.by_free[f]:
            self.free &= ~(1 << f)
        return found

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"length {n} is outside 1 to {self.capacity}")
        if fits := self.free >> n:
            f = n + (fits & -fits).bit_length() - 1  # least free space that fits: the fullest bin
            number = self._take(f)
        else:
            if self.open == self.limit:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
            f, number = self.capacity, self.bins
            self.bins += 1
            self.open += 1
        left = f - n
        if left:
            self.by_free[left].append(number)
            self.free |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - f


def pack(
    rows: DataFrame, capacity: int = MAX_LEN, open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a length (1 to ``capacity``), of a table that reads alike each time."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() << 40
        for window in _windows(batches, 2 * open_bins):
            window = window.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece") if c in window.schema.names)])
            got = [packer.place(n) for n in window.column("length").to_pylist()]
            seq = pa.array([base + x for x, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([*window.columns, seq, pa.array([x for _, x in got], pa.int64())], names=[*window.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    tasks = max(1, -(-rows.count() // rows_per_task))
    # Dealt out and ordered by a hash of the row's place in the table, so rows with equal ids, null ones or repeated ones meet in no task and no window more than others
    # do; a repeated task reads the same places and so sees the same order.
    order = free_name(rows.columns, "order")
    numbered = rows.withColumn(order, F.xxhash64(F.monotonically_increasing_id()))
    spread = numbered.repartition(tasks, order).sortWithinPartitions(order).drop(order)
    return spread.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``size``."""
    held, n = [], 0
    for batch in batches:
        while n + batch.num_rows >= size:
            held.append(batch.slice(0, size - n))
            batch = batch.slice(size - n)
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def best_fit(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID, **options) -> DataFrame:
    """Documents packed into sequences of at most ``max_len`` tokens; see the module's text."""
    return pack(materialise(pieces(docs, tokenizer, max_len, end_id), "pieces"), max_len, **options)
