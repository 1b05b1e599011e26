"""Token counts that follow edits (operator 9).

Each document has a tree, which is kept in a table. Its leaves are runs of whole pre-tokens, about ``LEAF_BYTES`` bytes each, that begin where
a blank run begins: no pre-token reaches over such a place, whatever stands further away. Above them a segment tree holds sums of characters
and tokens. ``build`` encodes every text once and writes, in one pass, a row for each leaf (its text, characters and tokens) and a row for each document
(the sums of its tree, as an array in the order of a heap).

``apply_edits`` brings edits (from, to, replacement) to trees that are there. The sums alone are read to descend to the leaves that an edit touches, plus
a neighbour where it touches a leaf's edge (the boundary context); overlapping runs of leaves are one *region*. Only leaves of regions are joined, edited, cut,
and counted anew, and only the sums above them change. All else keeps its counts. The result is a set of trees again, and a report: counts before and after, the characters
that the encoder saw when the tree was built, and those that it saw for the edits. Trees keep their shape: what an edit adds stays in the leaves of its region, the last of which may grow.

``edited_counts`` does both for edits that a given function finds in each text; they are noted while the trees are built. Trees in a folder of the caller's outlive the session
(``build(..., path=...)``, ``Trees.save``, ``open_trees``).

Defined cases: null and empty texts have 0 tokens and one empty leaf; null ids pass through (a table of edits cannot address them); rows that share an id, repeated rows among them, have a tree
each and get the same edits; edits outside the text, or that overlap, raise an error; two edits at one place apply in the order of their replacements; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import words
from .shared import fresh_path, materialise, scratch
from .tokens import BatchEncoder, batch_encoder

LEAF_BYTES = 256
EDITS = "array<struct<start:int,end:int,new:string>>"
LEAF = "tree long, leaf int, text string, chars int, tokens int"
SUMS = "tree long, doc_id long, n_leaves int, sum_chars array<int>, sum_tokens array<int>"
NODES = f"tree long, doc_id long, leaf int, text string, chars int, tokens int, n_leaves int, sum_chars array<int>, sum_tokens array<int>, edits {EDITS}"
REGION = f"tree long, region int, last int, edits {EDITS}"
Edit = tuple[int, int, str]

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD2, _LEAD3, _LEAD4 = (np.zeros(256, bool) for _ in range(3))  # first bytes of characters among which there is no blank
_LEAD2[0xC3:0xE0] = True
_LEAD3[[0xE0, *range(0xE4, 0xEE)]] = True
_LEAD4[0xF0:0xF5] = True


def leaf_starts(data: np.ndarray, at: np.ndarray, leaf_bytes: int = LEAF_BYTES) -> np.ndarray:
    """Where leaves begin, in a buffer of texts that begin at ``at``: with each text that is not empty, and at the first of its places in each stretch of
    ``leaf_bytes`` where an ASCII blank follows a character that is surely none."""
    begin = at[:-1][np.diff(at) > 0]
    n = len(data)
    if n < 2:
        return begin
    before = _VISIBLE[data[:-1]]
    for k, lead in ((1, _LEAD2), (2, _LEAD3), (3, _LEAD4)):
        if n > k + 1:
            before[k:] |= lead[data[: -k - 1]] & ((data[k:-1] & 0xC0) == 0x80)
    place = np.flatnonzero(before & ~words.BLANKS[data[1:]]) + 1
    text = np.searchsorted(at, place, side="right") - 1
    stretch = (place - at[text]) // leaf_bytes
    ok = (stretch > 0) & (place > at[text])
    place, text, stretch = place[ok], text[ok], stretch[ok]
    first = np.ones(len(place), bool)
    first[1:] = (text[1:] != text[:-1]) | (stretch[1:] != stretch[:-1])
    return np.union1d(begin, place[first])


def cut(texts: pa.Array, leaf_bytes: int = LEAF_BYTES) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(leaves of all texts, their characters, number of leaves of each text); a text without characters has one empty leaf."""
    data, at = words.buffers(texts)
    start = leaf_starts(data, at, leaf_bytes)
    empty = np.flatnonzero(np.diff(at) == 0)
    start = np.insert(start, np.searchsorted(start, at[empty]), at[empty])
    edge = np.append(start, len(data))
    leaves = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    owner = np.searchsorted(at[1:], start, side="right")
    # An empty text and the next one begin at the same place: empty leaves belong to the former.
    owner[np.diff(edge) == 0] = empty
    return leaves, np.diff(points[edge]), np.bincount(owner, minlength=len(at) - 1)


def counts(enc: BatchEncoder, leaves: pa.Array) -> np.ndarray:
    return np.diff(enc.encode(leaves)[1])


def heap(values: np.ndarray) -> np.ndarray:
    """The segment tree over ``values``: node i has the nodes 2i and 2i + 1 below it, and leaves begin at half the length."""
    base = 1 << max(0, len(values) - 1).bit_length()
    out = np.zeros(2 * base, np.int32)
    out[base : base + len(values)] = values
    while base > 1:
        half = base // 2
        out[half:base] = out[base : 2 * base : 2] + out[base + 1 : 2 * base : 2]
        base = half
    return out


def change(sums: np.ndarray, leaf: np.ndarray, values: np.ndarray) -> None:
    """Give new values to leaves, and new sums to the nodes above them alone."""
    node = len(sums) // 2 + leaf
    sums[node] = values
    node = np.unique(node // 2)
    while len(node) and node[-1]:
        sums[node] = sums[2 * node] + sums[2 * node + 1]
        node = np.unique(node // 2)


def _find(chars: np.ndarray, at: int) -> tuple[int, int]:
    """The leaf that holds character ``at`` (for the text's end, the last one with characters), and its first character."""
    i, before, base = 1, 0, len(chars) // 2
    at = min(at, max(int(chars[1]) - 1, 0))
    while i < base:
        i *= 2
        if at - before >= chars[i]:
            before += int(chars[i])
            i += 1
    return i - base, before


def regions(chars: np.ndarray, n_leaves: int, edits: list[Edit]) -> list[tuple[int, int, list[Edit]]]:
    """(first leaf, last leaf, edits in places of the region) of disjoint regions, by descent through the sums."""
    out: list[tuple[int, int, int, list[Edit]]] = []
    edits, total = sorted(edits), int(chars[1])
    for (_, end, _), (start, _, _) in zip(edits, edits[1:], strict=False):
        if start < end:
            raise ValueError("edits overlap")
    for start, end, new in edits:
        if not 0 <= start <= end <= total:
            raise ValueError(f"edit {start} to {end} is outside a text of {total}")
        # A character of context on either side: a leaf's edge holds only while both characters at it stay.
        first, at = _find(chars, max(start - 1, 0))
        last = min(_find(chars, min(end + 1, total))[0], n_leaves - 1)
        if not total:
            first, last, at = 0, n_leaves - 1, 0
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2], [*out[-1][3], (start, end, new)])
        else:
            out.append((first, last, at, [(start, end, new)]))
    return [(first, last, [(a - at, b - at, new) for a, b, new in own]) for first, last, at, own in out]


def rewritten(text: str, edits: list[Edit]) -> str:
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def fitted(leaves: list[str], room: int) -> list[str]:
    """Leaves in exactly ``room`` places: what is over goes to the last one, places left are empty."""
    if len(leaves) > room:
        leaves = [*leaves[: room - 1], "".join(leaves[room - 1 :])]
    return leaves + [""] * (room - len(leaves))


def recount(enc: BatchEncoder, texts: list[str], rooms: list[int], leaf_bytes: int = LEAF_BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(leaves, characters, tokens) of the new texts of regions, one after another, each in as many leaves as it had."""
    made, _, n = cut(pa.array(texts, pa.large_string()), leaf_bytes)
    listed, out, at = made.to_pylist(), [], 0
    for k, room in zip(n.tolist(), rooms, strict=True):
        out += fitted(listed[at : at + k], room)
        at += k
    return out, np.fromiter(map(len, out), np.int64, len(out)), counts(enc, pa.array(out, pa.large_string()))


class TokenTree:
    """One tree in memory, by the same functions. ``encoded`` counts all characters that the encoder saw, those of the build among them."""

    def __init__(self, text: str, enc: BatchEncoder, leaf_bytes: int = LEAF_BYTES):
        self.enc, self.leaf_bytes, self.encoded = enc, leaf_bytes, len(text)
        leaves, chars, _ = cut(pa.array([text], pa.large_string()), leaf_bytes)
        self.leaves, self.chars, self.tokens = leaves.to_pylist(), heap(chars), heap(counts(enc, leaves))

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, *edits: Edit) -> None:
        """Edits in places of the text before any of them."""
        for first, last, own in regions(self.chars, len(self.leaves), list(edits)):
            new = rewritten("".join(self.leaves[first : last + 1]), own)
            self.leaves[first : last + 1], chars, tokens = recount(self.enc, [new], [last - first + 1], self.leaf_bytes)
            self.encoded += len(new)
            at = np.arange(first, last + 1)
            change(self.chars, at, chars)
            change(self.tokens, at, tokens)


_PRIVATE = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d[\d ().-]{5,}\d")


def redactions(text: str) -> list[Edit]:
    """Edits that mask mail addresses and long numbers."""
    return [(m.start(), m.end(), "[mail]" if "@" in m[0] else "[number]") for m in _PRIVATE.finditer(text)]


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


# --- tables of trees ---------------------------------------------------------------------------------------


@dataclass
class Trees:
    """``leaves``: see ``LEAF``. ``sums``: see ``SUMS``, and ``edits`` that were noted while building."""

    leaves: DataFrame
    sums: DataFrame
    tokenizer: str

    def save(self, path: str) -> Trees:
        """Write all trees into a folder of the caller's."""
        self.leaves.write.parquet(f"{path}/leaves")
        self.sums.write.parquet(f"{path}/sums")
        return open_trees(self.leaves.sparkSession, path, self.tokenizer)

    def texts(self) -> DataFrame:
        """(doc_id, text) of every tree."""
        joined = self.leaves.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "text"))), lambda x: x.text), "").alias("text"))
        return self.sums.join(joined, "tree").select("doc_id", "text")


def _of_nodes(nodes: DataFrame, tokenizer: str) -> Trees:
    leaves = nodes.where("leaf is not null").select("tree", "leaf", "text", "chars", "tokens")
    return Trees(leaves, nodes.where("leaf is null").select("tree", "doc_id", "n_leaves", "sum_chars", "sum_tokens", "edits"), tokenizer)


def open_trees(spark: SparkSession, path: str, tokenizer: str) -> Trees:
    """Trees that another session has saved or built at ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/sums")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return Trees(spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/sums"), tokenizer)
    return _of_nodes(spark.read.schema(NODES).parquet(path), tokenizer)


def build(docs: DataFrame, tokenizer: str, find: Callable[[str], list[Edit]] | None = None, path: str | None = None) -> Trees:
    """Trees of all ``docs`` (doc_id, text), written to ``path`` or, for the life of this driver, into the shared folder. ``find`` notes edits of each text."""
    schema = _arrow(NODES)
    large = pa.schema([pa.field(f.name, pa.large_string()) if f.name == "text" else f for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, tree = batch_encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for group in words.groups(batch, keep_caches=True):
                leaves, chars, n = cut(group.column("text"))
                tokens, first = counts(enc, leaves), np.concatenate([[0], np.cumsum(n)])
                ids = np.arange(tree, tree + group.num_rows)
                tree += group.num_rows
                noted = [[{"start": a, "end": b, "new": new} for a, b, new in find(t or "")] for t in group.column("text").to_pylist()] if find else pa.nulls(group.num_rows, schema.field("edits").type)
                of = lambda x: pa.array([heap(x[first[i] : first[i + 1]]) for i in range(len(n))], pa.list_(pa.int32()))  # noqa: B023, E731
                leaf = np.arange(len(leaves)) - np.repeat(first[:-1], n)
                none = {f.name: pa.nulls(len(leaves), f.type) for f in large}
                cols = {**none, "tree": pa.array(np.repeat(ids, n)), "leaf": pa.array(leaf.astype(np.int32)), "text": leaves, "chars": pa.array(chars.astype(np.int32)), "tokens": pa.array(tokens.astype(np.int32))}
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in large], schema=large).cast(schema)
                none = {f.name: pa.nulls(group.num_rows, f.type) for f in schema}
                cols = {**none, "tree": pa.array(ids), "doc_id": group.column("doc_id"), "n_leaves": pa.array(n.astype(np.int32)), "sum_chars": of(chars), "sum_tokens": of(tokens), "edits": pa.array(noted, schema.field("edits").type) if find else noted}
                yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    path = path or fresh_path(docs.sparkSession, "trees")
    own.mapInArrow(run, NODES).write.option("compression", "zstd").parquet(path)
    return _of_nodes(docs.sparkSession.read.schema(NODES).parquet(path), tokenizer)


def _located(todo: DataFrame) -> DataFrame:
    """Regions of edits: see ``REGION``; a region is known by its first leaf. ``todo``: sums with edits."""
    schema = _arrow(REGION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                edits = [(e["start"], e["end"], e["new"]) for e in r["edits"].as_py()]
                chars = np.asarray(r["sum_chars"].values)
                for first, last, own in regions(chars, r["n_leaves"].as_py(), edits):
                    out.append({"tree": r["tree"].as_py(), "region": first, "last": last, "edits": [{"start": a, "end": b, "new": new} for a, b, new in own]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return todo.select("tree", "n_leaves", "sum_chars", "edits").mapInArrow(run, REGION)


def _renewed(met: DataFrame, tokenizer: str) -> DataFrame:
    """New leaves of regions (tree, region, edits, parts: their old texts in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = batch_encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parts, edits = part.column("parts").to_pylist(), part.column("edits").to_pylist()
                texts = [rewritten("".join(p), [(e["start"], e["end"], e["new"]) for e in own]) for p, own in zip(parts, edits, strict=True)]
                rooms = np.fromiter(map(len, parts), np.int64, len(parts))
                leaves, chars, tokens = recount(enc, texts, rooms.tolist())
                first = np.repeat(part.column("region").to_numpy(), rooms)
                step = np.arange(len(leaves)) - np.repeat(np.cumsum(rooms) - rooms, rooms)
                tree = np.repeat(part.column("tree").to_numpy(), rooms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree), pa.array((first + step).astype(np.int32)), pa.array(leaves, pa.string()), pa.array(chars.astype(np.int32)), pa.array(tokens.astype(np.int32))], names=["tree", "leaf", "text", "chars", "tokens"]
                )
            words.release()

    return met.mapInArrow(run, LEAF)


def _summed(old: DataFrame) -> DataFrame:
    """Sums with the values of new leaves (``new``: leaf, chars, tokens) put in."""
    schema = _arrow(SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"sum_chars": [], "sum_tokens": []}
            for i in range(batch.num_rows):
                new = batch.column("new")[i].values
                leaf = np.asarray(new.field("leaf"))
                for c, of in (("sum_chars", "chars"), ("sum_tokens", "tokens")):
                    sums = np.array(batch.column(c)[i].values)
                    change(sums, leaf, np.asarray(new.field(of)))
                    out[c].append(sums)
            cols = [pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return old.select("tree", "doc_id", "n_leaves", "sum_chars", "sum_tokens", "new").mapInArrow(run, SUMS)


def apply_edits(trees: Trees, edits: DataFrame | None = None) -> tuple[Trees, DataFrame]:
    """Trees after the edits, and the report (doc_id, n_tokens, n_tokens_before, n_edits, n_chars, n_chars_built, n_chars_encoded) of every document.

    ``edits``: (doc_id, start, end, replacement), in characters of the texts; without it, those noted while building.
    """
    spark, sums = trees.sums.sparkSession, trees.sums
    if edits is not None:
        one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("replacement", F.lit("")).alias("new"))
        sums = sums.drop("edits").join(edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(one).alias("edits")), "doc_id", "left")
    with scratch(spark):
        region = materialise(_located(sums.where("size(edits) > 0")), "regions")
        wanted = region.select("tree", "region", F.explode(F.sequence("region", "last")).alias("leaf"))
        touched = wanted.join(trees.leaves.select("tree", "leaf", "text"), ["tree", "leaf"])
        parts = touched.groupBy("tree", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "text"))), lambda x: x.text).alias("parts"))
        new = materialise(_renewed(parts.join(region.select("tree", "region", "edits"), ["tree", "region"]), trees.tokenizer), "new-leaves", keep=True)
    by_tree = new.groupBy("tree").agg(F.collect_list(F.struct("leaf", "chars", "tokens")).alias("new"), F.sum("chars").alias("encoded"))
    moved = materialise(_summed(sums.join(by_tree.select("tree", "new"), "tree")), "new-sums", keep=True)
    same = sums.join(moved.select("tree"), "tree", "left_anti").select(*moved.columns)
    leaves = trees.leaves.join(new.select("tree", "leaf"), ["tree", "leaf"], "left_anti").unionByName(new)
    top = lambda c, name: F.coalesce(F.get(c, F.lit(1)), F.lit(0)).cast("long").alias(name)
    before = sums.select("tree", "doc_id", top("sum_tokens", "n_tokens_before"), F.greatest(F.size("edits"), F.lit(0)).cast("long").alias("n_edits"), top("sum_chars", "n_chars_built"))
    after = moved.join(by_tree.select("tree", "encoded"), "tree").select("tree", top("sum_tokens", "t"), top("sum_chars", "c"), "encoded")
    report = before.join(after, "tree", "left").select(
        "doc_id", F.coalesce("t", "n_tokens_before").alias("n_tokens"), "n_tokens_before", "n_edits", F.coalesce("c", "n_chars_built").alias("n_chars"), "n_chars_built", F.coalesce("encoded", F.lit(0)).cast("long").alias("n_chars_encoded")
    )
    return Trees(leaves, moved.unionByName(same).withColumn("edits", F.lit(None).cast(EDITS)), trees.tokenizer), report


def edited_counts(docs: DataFrame, tokenizer: str, find: Callable[[str], list[Edit]] = redactions) -> DataFrame:
    """The report of ``apply_edits`` for the edits that ``find`` gives for each text of ``docs``."""
    return apply_edits(build(docs, tokenizer, find))[1]
