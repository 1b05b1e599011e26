"""Token-id files with keyed access (operator 1).

Layout below one folder of the shared store:

- ``shard-NNNNNN.bin``: a 16-byte header (magic, bytes an id), then the raw ids of the shard's documents, end
  id included, nothing between. Shards are ranges of ascending doc_id, so the files in order hold the corpus.
- ``index-NNNNNN.mph``: documents whose key hashes to part N: a minimal perfect hash from key to
  entry number, then columns of entries: a 32-bit fingerprint, shard, first id, number of ids.
- ``copies.parquet``: (doc_id, copies) of the ids that several rows share.
- ``manifest.json``: the number of shards and of index parts, the first global id and the number of ids of each shard, bytes an id, end id and tokenizer.
  It is written last, so a folder with a manifest is whole.

``open_files`` opens a folder in any later session. A keyed read is one hash for the part, one perfect-hash probe, one fingerprint test and one range read, without a
Spark job. Files are written under temporary names and renamed, with names that depend on the task's part only: a task that
runs again after a lost executor replaces its file by the same bytes.

Rows that share an id, null ids among them, are numbered in the order of their texts (by the first 64 characters, then a hash), and spread: ranges are cut by (id, text), and a copy is a key of its own in the index. Their numbers come
from counts of equal ids by task, so no task holds all copies of an id.

Defined cases: null texts are empty (the end id alone); null ids are stored under the least 64-bit integer
and come first; rows with equal ids are kept, in that order, told apart by a copy number; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .mph import PerfectHash, fingerprint
from .shared import fresh_path, map_file, materialise, write_file
from .tokens import batch_encoder

END_ID = 2
NULL_KEY = -(1 << 63)
HEADER = 16
_MAGIC = b"LODETOK1"
KEYS_PER_INDEX, BLOCK = 200_000, 10_000
ENTRY = "doc_id long, shard int, at long, n_tokens long"
KEYED = "doc_id long, copy long, shard int, at long, n_tokens long"


def shard_uri(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:06d}.bin"


def index_uri(root: str, part: int) -> str:
    return f"{root}/index-{part:06d}.mph"


def _key(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return words.mix(doc_id.astype(np.int64).view(np.uint64)) + copy.astype(np.uint64) * words.K3


def _part_of(doc_id: np.ndarray, copy: np.ndarray, parts: int) -> np.ndarray:
    """The index part of each key."""
    return (words.mix(_key(doc_id, copy) ^ words.K2) % words.U(max(parts, 1))).astype(np.int32)


@dataclass
class TokenFiles:
    """A folder of token files, as its manifest tells."""

    root: str
    shards: int
    parts: int
    starts: list[int]
    sizes: list[int]
    width: int
    end_id: int
    tokenizer: str
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def _map(self, uri: str) -> pa.Buffer:
        if uri not in self._open:
            if len(self._open) > 64:
                self._open.clear()
            self._open[uri] = map_file(uri)
        return self._open[uri]

    def shard(self, number: int) -> np.ndarray:
        """All ids of a shard, as a view of the mapped file."""
        buf = self._map(shard_uri(self.root, number))
        if buf.slice(0, 8).to_pybytes() != _MAGIC or np.frombuffer(buf, "<u4", 1, 8)[0] != self.width:
            raise ValueError(f"shard {number} has no header")
        return np.frombuffer(buf, f"<u{self.width}", offset=HEADER)

    def locate(self, part: int, doc_ids: np.ndarray, copy: np.ndarray) -> dict[str, np.ndarray]:
        """Entries of keys of one index part; those that are absent have shard -1."""
        buf = self._map(index_uri(self.root, part))
        mph, at = PerfectHash.from_buffer(buf)
        n, cols = len(mph), {}
        for name, kind in (("at", np.int64), ("n_tokens", np.int64), ("shard", np.int32), ("print", np.uint32)):
            cols[name] = np.frombuffer(buf, kind, n, at)
            at += n * np.dtype(kind).itemsize
        key = _key(doc_ids, copy)
        if not n:
            return {k: np.full(len(key), -1 if k == "shard" else 0) for k in cols}
        slot = mph.number(key)
        safe = np.maximum(slot, 0)
        found = (slot >= 0) & (cols["print"][safe] == fingerprint(key))
        return {k: np.where(found, v[safe], -1 if k == "shard" else 0) for k, v in cols.items()}

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, or None: two mapped files are touched, nothing is scanned and no job runs."""
        key, copies = np.array([NULL_KEY if doc_id is None else doc_id], np.int64), np.array([copy])
        hit = self.locate(int(_part_of(key, copies, self.parts)[0]), key, copies)
        if hit["shard"][0] < 0:
            return None
        at, n = int(hit["at"][0]), int(hit["n_tokens"][0])
        return self.shard(int(hit["shard"][0]))[at : at + n]


def _manifest(files: TokenFiles) -> bytes:
    return json.dumps({k: v for k, v in files.__dict__.items() if k not in ("root", "_open")}).encode()


def open_files(root: str) -> TokenFiles:
    """What ``write`` has left at ``root``, in this session or another."""
    return TokenFiles(root, **json.loads(map_file(f"{root}/manifest.json").to_pybytes()))


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shards: int | None = None, path: str | None = None) -> TokenFiles:
    """Encode every document and write shards, index and manifest to ``path`` or, for the life of this driver, into the shared folder."""
    spark = docs.sparkSession
    root = path or fresh_path(spark, "tokens")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id"), F.col("text").cast("string"))
    shards = shards or max(1, rows.rdd.getNumPartitions())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = batch_encoder(tokenizer), TaskContext.get().partitionId()
        width = enc.dtype.itemsize
        entries: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def payload():
            at_all = 0
            yield _MAGIC + np.array([width, 0], "<u4").tobytes()
            for batch in batches:
                for group in words.groups(batch, keep_caches=True):
                    every, at = enc.encode(group.column("text"))
                    every = np.insert(every, at[1:], end_id)
                    n = np.diff(at) + 1
                    entries.append((group.column("doc_id"), at_all + np.cumsum(n) - n, n))
                    at_all += len(every)
                    yield every.tobytes()

        write_file(shard_uri(root, shard), payload())
        for ids, at, n in entries:
            yield pa.RecordBatch.from_arrays([ids, pa.array([shard] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "shard", "at", "n_tokens"])

    # Ranges by text too, so that rows that share an id are dealt out; the hash is the same for equal texts, which may lie in any order.
    ordered = rows.withColumn("_t", F.substring("text", 1, 64)).repartitionByRange(shards, "doc_id", "_t", F.xxhash64("text")).drop("_t").sortWithinPartitions("doc_id", F.substring("text", 1, 64), F.xxhash64("text"))
    entries = materialise(ordered.mapInArrow(encode, ENTRY), "token-entries")
    # One row for each shard, so as much as a listing of the files.
    totals = {r["shard"]: (r["n"], r["docs"]) for r in entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
    shards = max([shards - 1, *totals]) + 1  # Spark may deal a range out to more tasks than asked for
    sizes = [int(totals.get(i, (0, 0))[0]) for i in range(shards)]
    starts = [int(x) for x in np.cumsum([0, *sizes])[:-1]]
    parts = max(1, -(-sum(n for _, n in totals.values()) // KEYS_PER_INDEX))
    # The copy number of a row: the rows of its id in shards before, and those before it in its own.
    many = materialise(entries.groupBy("doc_id", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first")), "token-runs")
    shared = many.groupBy("doc_id").agg(F.sum("n").alias("copies")).where("copies > 1")
    shared.write.parquet(f"{root}/copies.parquet")
    shared = spark.read.schema(shared.schema).parquet(f"{root}/copies.parquet")
    runs = many.join(shared.select("doc_id"), "doc_id", "left_semi").withColumn("before", F.sum("n").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.select("doc_id", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    single = entries.join(shared.select("doc_id"), "doc_id", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    again = _numbered(entries.join(shared.select("doc_id"), "doc_id", "left_semi"), runs, shards)
    keyed = single.unionByName(again)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part_of(batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy(), parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=[*batch.schema.names, "part"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, got = TaskContext.get().partitionId(), list(batches)  # about KEYS_PER_INDEX rows, as copies are keys of their own
        col = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in got] or [np.zeros(0, np.int64)])
        key = _key(col("doc_id"), col("copy"))
        mph = PerfectHash.build(key)
        slot = mph.number(key)
        parts_ = [mph.to_bytes()]
        for values, kind in ((col("at"), np.int64), (col("n_tokens"), np.int64), (col("shard"), np.int32), (fingerprint(key), np.uint32)):
            column = np.zeros(len(key), kind)
            column[slot] = values
            parts_.append(column.tobytes())
        write_file(index_uri(root, part), parts_)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(key)], pa.int64())], names=["part", "n"])

    dealt = keyed.select("doc_id", "copy", "shard", "at", "n_tokens").mapInArrow(placed, f"{KEYED}, part int").repartitionById(parts, F.col("part"))
    built = dealt.mapInArrow(index, "part int, n long")
    for part in set(range(parts)) - {r["part"] for r in built.collect()}:  # parts without keys
        write_file(index_uri(root, part), [PerfectHash.build(np.zeros(0, np.uint64)).to_bytes()])
    for shard in set(range(shards)) - set(totals):  # ranges without rows, whose tasks may not have run
        write_file(shard_uri(root, shard), [_MAGIC + np.array([batch_encoder(tokenizer).dtype.itemsize, 0], "<u4").tobytes()])
    files = TokenFiles(root, shards, parts, starts, sizes, batch_encoder(tokenizer).dtype.itemsize, end_id, tokenizer)
    write_file(f"{root}/manifest.json", [_manifest(files)])
    return open_files(root)


def _numbered(entries: DataFrame, runs: DataFrame, shards: int) -> DataFrame:
    """Adds ``copy`` to rows that share ids: counted on in each shard's order, from the number of the id's rows in shards before."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, n = None, None, 0
        for batch in batches:
            out = []
            for key, s in zip(batch.column("doc_id").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                n = n + 1 if (key, s) == (last, shard) else 0
                last, shard = key, s
                out.append(n)
            copy = pa.array(np.array(out, np.int64) + batch.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id",)), copy, *(batch.column(c) for c in ("shard", "at", "n_tokens"))], names=["doc_id", "copy", "shard", "at", "n_tokens"])

    met = entries.join(runs, ["doc_id", "shard"])
    return met.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "at").mapInArrow(number, KEYED)


def read(files: TokenFiles, doc_ids: DataFrame) -> DataFrame:
    """Keyed reads: (doc_id, start, n_tokens, ids_crc32) of each id asked for, once for each copy stored.

    Ids that are not stored give no row. ``start`` counts the ids of all documents before it.
    """
    spark, starts = doc_ids.sparkSession, np.array(files.starts or [0], np.int64)
    asked = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc_id")).distinct()
    copies = spark.read.schema("doc_id long, copies long").parquet(f"{files.root}/copies.parquet")
    # Copies of one id are keys of their own in different parts: a row for each.
    # In two steps, so that no row holds an array of all copies of an id.
    many = asked.join(copies, "doc_id", "left").select("doc_id", F.coalesce("copies", F.lit(1)).alias("copies"))
    block = many.select("doc_id", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK))).alias("b"))
    keys = block.select("doc_id", F.explode(F.sequence(F.col("b") * BLOCK, F.least((F.col("b") + 1) * BLOCK, "copies") - 1)).alias("copy"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part_of(batch.column("doc_id").to_numpy(), batch.column("copy").to_numpy(), files.parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part)], names=["doc_id", "copy", "part"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copy, parts = (batch.column(c).to_numpy() for c in ("doc_id", "copy", "part"))
            for part in np.unique(parts).tolist():
                own = np.flatnonzero(parts == part)
                hit = files.locate(part, ids[own], copy[own])
                ok = hit["shard"] >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own][ok], pa.int64()), pa.array(hit["shard"][ok], pa.int32()), pa.array(hit["at"][ok], pa.int64()), pa.array(hit["n_tokens"][ok], pa.int64())], names=["doc_id", "shard", "at", "n_tokens"]
                )

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, at, n = (batch.column(c).to_pylist() for c in ("shard", "at", "n_tokens"))
            crc = [zlib.crc32(files.shard(s)[a : a + k].astype("<u4").tobytes()) for s, a, k in zip(shard, at, n, strict=True)]
            start = [int(starts[s]) + a for s, a in zip(shard, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = keys.mapInArrow(placed, "doc_id long, copy long, part int").repartitionById(files.parts, F.col("part")).mapInArrow(locate, "doc_id long, shard int, at long, n_tokens long")
    dealt = found.repartitionById(files.shards, F.col("shard")).sortWithinPartitions("shard", "at")
    out = dealt.mapInArrow(payload, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))
