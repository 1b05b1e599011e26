"""Removal of long repeated word sequences by de Bruijn compaction (operator 10).

The edges of the graph are runs of ``WINDOW`` words. Storing every edge would take many times the input,
so edges are compacted where they arise: each edge is labelled with the least-hashed ``SEED`` words inside it, and
consecutive edges of a document with one and the same labelled place form a *path* of edges that can branch only at its
ends. A path is kept as five numbers: label, hash of all its words, document, first edge, number of edges.
Equal edges always have equal labels at equal offsets, so repeats are found among paths of one label.

1. ``paths``: a map over the documents. A path that follows itself (periodic text) is counted, not repeated.
2. Spark joins compact: paths of equal label and content are one node with its least document. A label with a single node never
   branches: every occurrence outside the least document is a repeat as a whole, as it is for any node.
3. The source coordinates of each repeated node, in its least document, are looked up in the texts again, where the real words of the path are
   digested (cryptographically, 128 bits) as its *proof*. Where a label has several nodes, the graph branches inside them: there the words of each single edge
   are digested too, and the least document of each edge decides.
4. The source coordinates of all repeats are joined to the texts. A path counts only if its own words have the source's proof, so neither a label nor a content hash
   decides alone; then the texts give the words that remain.

Aggregations are minima and maxima, which Spark combines before the shuffle, and the joins back are plain equi-joins that it can
split where one label holds many rows. Nothing collects the members of a group; what is collected are the distinct places of one document.

Defined cases: null texts have no words; documents with null ids are neither sources of repeats nor
trimmed; rows that share a doc_id are one document in the comparison of ids, so they do not trim each
other; rows equal in id and text get the same result each, at a cost in proportion to their number; empty tables give no rows; extra columns, of whatever
names, are ignored by the digest and pass through ``dedup_texts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import free_name, materialise, plain_names, quoted, scratch

WINDOW, SEED = 50, 10
PATH = "label long, content long, doc_id long, text_key long, at int, n int, reps int"
#: A node's path (content, proof) or a single edge (proof, at, step, count); content is null for the latter.
LOOKED = "label long, content long, proof binary, doc_id long, text_key long, at int, step int, count int"
LOOKED_NAMES = ["label", "content", "proof", "doc_id", "text_key", "at", "step", "count"]
GROUP = 1 << 20
KEY = ["doc_id", "text_key"]


def _labels(seeds: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` seeds, the place of its least one (the first of equals), as 32-bit hash and place."""
    key = (seeds & words.U(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
    have = 1
    while have * 2 <= span:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    return (key & words.U(0xFFFFFFFF)).astype(np.int64)


def _paths(group: pa.RecordBatch, window: int, seed: int) -> dict[str, np.ndarray] | None:
    w = words.split(group.column("text"))
    total = len(w.start)
    if total < window:
        return None
    h = w.hashes()
    seeds = words.windows(h, seed)
    label = _labels(seeds, window - seed + 1)  # one for each edge, across documents too
    ok = words.whole(w.first, window, total)
    edges = np.flatnonzero(ok)
    if not len(edges):
        return None
    place = label[edges]
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(edges) != 1)) + 1
    begin = np.concatenate([[0], cut])
    n = np.diff(np.append(begin, len(edges)))
    at = edges[begin]
    raw = h.tobytes()
    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(at.tolist(), (at + n + window - 1).tolist(), strict=True)), np.uint64, len(at))
    doc = np.searchsorted(w.first, at, side="right") - 1
    lab = seeds[place[begin]]
    # A path that follows itself: same label, content and size, right behind.
    same = (lab[1:] == lab[:-1]) & (content[1:] == content[:-1]) & (n[1:] == n[:-1]) & (at[1:] == at[:-1] + n[:-1]) & (doc[1:] == doc[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    reps = np.diff(np.append(head, len(at)))
    return {"label": lab[head].view(np.int64), "content": content[head].view(np.int64), "doc": doc[head], "at": (at - w.first[doc])[head], "n": n[head], "reps": reps}


def paths(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Compacted edges of every document: see ``PATH``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch, size=GROUP):
                if (p := _paths(group, window, seed)) is None:
                    continue
                ids = [group.column(c).take(pa.array(p["doc"])) for c in ("doc_id", "text_key")]
                ints = [pa.array(p[c], pa.int32()) for c in ("at", "n", "reps")]
                yield pa.RecordBatch.from_arrays([pa.array(p["label"]), pa.array(p["content"]), *ids, *ints], names=["label", "content", "doc_id", "text_key", "at", "n", "reps"])

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(walk, PATH)


def proof(raw: bytes, at: np.ndarray, first: int, n: int) -> bytes:
    """A 128-bit cryptographic digest of the ``n`` words from number ``first`` on, taken from ``words.spaced``."""
    end = int(at[first + n]) - 1 if first + n < len(at) else len(raw) - 1
    return hashlib.blake2b(raw[int(at[first]) : end], digest_size=16).digest()


def _looked_up(window: int) -> Callable:
    """The words at the source coordinates asked for: a proof of each node's path, and of each single edge where the graph branches."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch, size=GROUP):
                w = words.split(group.column("text"))
                raw, place = words.spaced(w)
                asked = group.column("asked")
                doc = np.repeat(np.arange(group.num_rows), np.diff(np.asarray(asked.offsets)).astype(np.int64))
                flat = asked.flatten()
                at, n, reps, label, content, branches = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "reps", "label", "content", "branches"))
                first = w.first[doc] + at
                path = pa.array([proof(raw, place, f, k + window - 1) for f, k in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())
                ids = [group.column(c).take(pa.array(doc)) for c in KEY]
                none = pa.nulls(len(doc), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(content), path, *ids, none, none, none], names=LOOKED_NAMES)
                one = np.repeat(np.flatnonzero(branches), n[branches])
                if not len(one):
                    continue
                count = n[branches].astype(np.int64)
                step = np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
                edge = pa.array([proof(raw, place, f, window) for f in (first[one] + step).tolist()], pa.binary())
                ids = [group.column(c).take(pa.array(doc[one])) for c in KEY]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[one]), pa.nulls(len(one), pa.int64()), edge, *ids, *(pa.array(x.astype(np.int32)) for x in (at[one] + step, n[one], reps[one]))],
                    names=LOOKED_NAMES,
                )

    return look


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tells apart rows that share an id."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text"))


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, spans): where the windows of a document begin that also start in a document with a lesser id.

    A span (at, step, count, n, proof) stands for ``count`` windows, ``step`` words apart; one with a proof is made of paths of ``n`` windows each,
    whose words must have that digest, as those of the source have. ``docs`` comes from ``keyed``; each key has one row, however often it is there.
    """
    with scratch(docs.sparkSession):
        return materialise(_repeats(docs, window, seed), "spans", keep=True)


def _repeats(docs: DataFrame, window: int, seed: int) -> DataFrame:
    with scratch(docs.sparkSession):  # the table of all paths is the bulk, so it goes as soon as those in play are known
        found = materialise(paths(docs, window, seed), "paths")
        nodes = found.groupBy("label", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        labels = (
            nodes.groupBy("label")
            .agg(F.count("*").alias("nodes"), F.min("least").alias("lo"), F.max("most").alias("hi"))
            .where("lo < hi")
            .select("label", "nodes")
        )
        # Nodes of labels that two documents have; all other paths are out of play from here on.
        nodes = materialise(nodes.join(labels, "label").select("label", "content", "least", "nodes"), "nodes")
        met = materialise(found.join(nodes, ["label", "content"]), "paths-in-play", keep=True)
    # Sets, as rows that repeat a key bring equal paths: one list for each key, whatever the number of its rows.
    sources = met.where("doc_id = least")
    asked = sources.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n", "reps", "label", "content", (F.col("nodes") > 1).alias("branches"))).alias("asked"))
    looked = materialise(docs.join(asked, KEY).select(*KEY, "text", "asked").mapInArrow(_looked_up(window), LOOKED), "looked-up")
    proofs = looked.where("content is not null").groupBy("label", "content").agg(F.min("proof").alias("proof"))
    later = met.where("doc_id > least").join(proofs, ["label", "content"])
    later = later.select(*KEY, F.struct(F.col("at"), F.lit(1).alias("step"), (F.col("n") * F.col("reps")).alias("count"), "n", "proof").alias("span"))
    edges = looked.where("content is null")
    least = edges.groupBy("label", "proof").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("label", "proof", "least")
    single = edges.join(least, ["label", "proof"]).where("doc_id > least")
    single = single.select(*KEY, F.struct("at", "step", "count", F.lit(1).alias("n"), F.lit(None).cast("binary").alias("proof")).alias("span"))
    return later.unionByName(single).groupBy(*KEY).agg(F.collect_set("span").alias("spans"))


def covered(spans, n_words: int, window: int, raw: bytes = b"", place: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """Which words of a text of ``n_words`` the windows of its spans cover; ``raw`` and ``place`` are ``words.spaced``, in which the text begins
    with word ``first``. A path whose words don't have the digest of its source's words is left out."""
    d = np.zeros(n_words + 1, np.int64)
    for s in spans:
        at, step, count, n, wanted = s["at"], s["step"], s["count"], s["n"], s["proof"]
        if wanted is not None:
            for a in range(at, at + count, n):
                if proof(raw, place, first + a, n + window - 1) == wanted:
                    d[a] += 1
                    d[a + n + window - 1] -= 1
        else:
            begin = at + step * np.arange(count)
            d[begin] += 1
            d[begin + window] -= 1
    return np.cumsum(d[:-1]) > 0


def _with_spans(docs: DataFrame, rows: DataFrame, window: int, seed: int, key: str = "text_key", spans: str = "spans") -> DataFrame:
    """``rows`` with the column ``spans``; they have doc_id and the hash of the text as ``key``."""
    found = repeats(docs, window, seed).select("doc_id", F.col("text_key").alias(key), F.col("spans").alias(spans))
    return rows.join(found, ["doc_id", key], "left")


def _each(window: int, make: Callable, column: str = "spans") -> Callable:
    """Calls ``make(group, words, removed flags of the group's words)`` for groups of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch, size=GROUP):
                w = words.split(group.column("text"))
                gone, spaced = np.zeros(len(w.start), bool), None
                for i, spans in enumerate(group.column(column).to_pylist()):
                    if spans:
                        spaced = spaced or words.spaced(w)
                        first = int(w.first[i])
                        gone[first : w.first[i + 1]] = covered(spans, int(w.first[i + 1]) - first, window, *spaced, first)
                yield make(group, w, gone)

    return run


def dedup_digest(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def make(group: pa.RecordBatch, w: words.Words, gone: np.ndarray) -> pa.RecordBatch:
        digests, removed = [], []
        start, end = w.start.tolist(), w.end.tolist()
        raw = w.data.tobytes()
        for i in range(group.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            removed.append(int(gone[a:b].sum()))
            if not removed[-1]:
                kept = b" ".join(raw[w.text_at[i] : w.text_at[i + 1]].split())
            else:
                kept = b" ".join([raw[start[j] : end[j]] for j in (np.flatnonzero(~gone[a:b]) + a).tolist()])
            digests.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays(
            [group.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    own = keyed(docs)
    return _with_spans(own, own, window, seed).mapInArrow(_each(window, make), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with all columns, their texts without repeated words, and a last column with the number of removed words.

    That column is called n_removed, with underscores behind it where ``docs`` has a column of that name. A text that loses no word
    stays as it is. A removed run goes with the blanks behind it, so line ends elsewhere stay.
    """
    key, found, count = (free_name(docs.columns, c) for c in ("text_key", "spans", "n_removed"))
    columns = plain_names(docs.columns)

    def make(group: pa.RecordBatch, w: words.Words, gone: np.ndarray) -> pa.RecordBatch:
        raw = w.data.tobytes()
        texts, removed = [], []
        given = group.column("text").to_pylist()
        for i in range(group.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            own = gone[a:b]
            removed.append(int(own.sum()))
            if not removed[-1]:
                texts.append(given[i])
                continue
            lo, hi = int(w.text_at[i]), int(w.text_at[i + 1])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            parts, at = [], lo
            for s, e in zip((edge[::2] + a).tolist(), (edge[1::2] + a).tolist(), strict=True):
                parts.append(raw[at : w.start[s]])
                at = int(w.start[e]) if e < b else hi
            texts.append(b"".join([*parts, raw[at:hi]]).decode())
        kept = [pa.array(texts, pa.string()) if c == "text" else group.column(c) for c in columns]
        return pa.RecordBatch.from_arrays([*kept, pa.array(removed, pa.int64())], names=[*columns, count])

    rows = docs.toDF(*columns).withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = _with_spans(keyed(rows), rows.withColumn(key, F.xxhash64("text")), window, seed, key, found)
    return marked.mapInArrow(_each(window, make, found), f"{schema}, {quoted(count)} long").toDF(*docs.columns, count)
