"""Near-duplicate classes by DartMinHash signatures (operator 4).

Signatures. Every element (a shingle of five words) owns a plane of weight by rank, on which darts fall as a
Poisson process fixed by the element's hash alone. A text of total weight W takes the darts below rank t / W,
t = k ln k + 2k, that fall below the weight of their element: about t darts, whatever W. Each dart is hashed
to one of k coordinates, which keeps its earliest dart; a text with an empty coordinate goes on to twice the rank. Two texts
agree on a coordinate with the probability of their weighted Jaccard similarity. Here planes are cut into strips of unit weight,
in each of which arrivals follow one another with exponential gaps; the production query takes the weight 1, i.e. the
plain Jaccard similarity of shingle sets, and ``weights="count"`` takes multiplicities.

Classes. Copies (equal word sequences) collapse first, so later steps see different texts only. Coordinates are banded
(32 bands of 4: a pair at similarity 0.8 is missed with probability 5e-8). No bucket is expanded into pairs. Each text is first verified,
exactly on the shingle sets, against the leader (least member) that it meets in most buckets; then, where a bucket still holds two classes,
members against the leader of another class. Buckets that hold two classes even then, as those of a much-copied passage do, are settled
by an exact way: their texts are joined on the rarest fifth of their shingles, in one of which two texts at the threshold must meet (prefix filter with positions),
and groups of that join are worked off leader by leader, with four times as many leaders a round from the third round on, up to ``LEADERS``. So every pair that shares a bucket
is verified, excluded by the filter, or in one class already. Classes are connected components of verified links, named by their least doc_id.

Defined cases: a text of one to four words is one shingle; null texts and texts without words are alone; null ids have a
null class and join nobody; rows that share an id are one document, known by the text of the least hash, and each such row is returned;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import materialise, scratch, tidy

SHINGLE, K, ROWS, THRESHOLD = 5, 128, 4, 0.8
SIGNED = "doc_id long, text_key long, content array<long>, bands array<long>"
GROUP = 2 << 20
#: The most leaders of a group in one round, so that no round brings more than so many rows to each member of a group.
LEADERS = 256


def shingles(w: words.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the distinct shingles of each text, sorted by both."""
    h, counts = w.hashes(), w.counts
    ok = words.whole(w.first, n, len(h))
    at = np.flatnonzero(ok)
    doc = np.searchsorted(w.first, at, side="right") - 1
    element = words.windows(h, n)[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.array([xxhash.xxh3_64_intdigest(h[w.first[i] : w.first[i + 1]].tobytes()) for i in short], np.uint64)
        doc, element = np.concatenate([doc, short]), np.concatenate([element, own])
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    head = np.flatnonzero(new)
    return doc[head], element[head], np.diff(np.append(head, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """``n_docs`` rows of k dart names; rows of texts without elements are zero. ``doc`` is sorted."""
    out = np.zeros((n_docs, k), np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    todo = total > 0
    limit = np.divide(k * math.log(k) + 2 * k, total, out=np.zeros(n_docs), where=todo)
    strips = np.ceil(weight).astype(np.int64)
    which = np.repeat(np.arange(len(doc)), strips)
    strip = np.arange(len(which)) - np.repeat(np.cumsum(strips) - strips, strips)
    base, owner, room = words.mix(element[which] + strip.astype(np.uint64) * words.K1), doc[which], weight[which] - strip
    while todo.any():
        live = np.flatnonzero(todo[owner])
        rank = np.zeros(len(live))
        best = np.full(n_docs * k, np.inf)
        cells, ranks, names = [], [], []
        n = 0
        while len(live):
            n += 1
            dart = words.mix(base[live] + words.U(n * int(words.K2) % (1 << 64)))
            rank = rank - np.log(((dart >> words.U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            keep = rank <= limit[owner[live]]
            live, rank, dart = live[keep], rank[keep], dart[keep]
            other = words.mix(dart ^ words.K3)
            inside = slice(None)
            if (room[live] < 1).any():  # a strip cut by its element's weight
                inside = np.flatnonzero(((other >> words.U(11)).astype(np.float64) * 2.0**-53) < room[live])
            cell = owner[live][inside] * k + (other[inside] % words.U(k)).astype(np.int64)
            np.minimum.at(best, cell, rank[inside])
            cells.append(cell)
            ranks.append(rank[inside])
            names.append(dart[inside])
        cell, rank, dart = np.concatenate(cells), np.concatenate(ranks), np.concatenate(names)
        first = rank == best[cell]
        out.reshape(-1)[cell[first]] = dart[first]
        full = np.isfinite(best.reshape(n_docs, k)).all(axis=1)
        todo &= ~full
        limit = limit * 2
    return out


def sign(docs: DataFrame, k: int = K, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """(doc_id, text_key, content, bands) of documents that have an id and a word: see ``SIGNED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch, size=GROUP):
                w = words.split(group.column("text"))
                doc, element, count = shingles(w)
                weight = count.astype(np.float64) if weights == "count" else np.ones(len(doc))
                sig = signatures(doc, element, weight, group.num_rows, k)
                band = np.zeros((group.num_rows, k // rows), np.uint64)
                for j in range(rows):
                    band = words.mix(band * words.K3 + sig[:, j::rows])
                band = words.mix(band + np.arange(k // rows, dtype=np.uint64) * words.K0)  # a band is no other band's
                keep = np.flatnonzero(w.counts)
                raw = w.hashes()
                content = []
                for i in keep:
                    d = xxhash.xxh3_128_digest(raw[w.first[i] : w.first[i + 1]].tobytes())
                    content.append(np.frombuffer(d, np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [group.column("doc_id").take(pa.array(keep)), group.column("text_key").take(pa.array(keep)), pa.array(content, pa.list_(pa.int64())), pa.array(list(band[keep].view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "content", "bands"],
                )

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(run, SIGNED)


def _sets(docs: DataFrame) -> DataFrame:
    """(id, n, elements): sorted distinct shingles of each text, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in words.groups(batch, size=GROUP):
                doc, element, _ = shingles(words.split(group.column("text")))
                cut = np.searchsorted(doc, np.arange(group.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(element.view(np.int64)))
                yield pa.RecordBatch.from_arrays([group.column("id"), pa.array(np.diff(cut), pa.int32()), lists], names=["id", "n", "elements"])

    return docs.mapInArrow(run, "id long, n int, elements array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Adds whether the exact similarity of a and b reaches ``threshold``."""
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b").join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a")
    common = F.size(F.array_intersect("ea", "eb")).cast("long")
    # c / (x + y - c) >= p / q, in integers, so that a pair at the threshold is linked
    p, q = Fraction(str(threshold)).as_integer_ratio()
    return both.select("a", "b", (common * (p + q) >= p * (F.size("ea") + F.size("eb")).cast("long")).alias("linked"))


class _Classes:
    """Labels of texts, and the links judged so far; every step ends in tables in the shared folder."""

    def __init__(self, sets: DataFrame, threshold: float):
        self.sets, self.threshold = sets, threshold
        self.label = sets.select("id", F.col("id").alias("component"), "n")
        self.judged: DataFrame | None = None

    def groups(self, member: DataFrame) -> DataFrame:
        """Rows (key, id) of groups that hold two classes, with component, n, and the group's least id as ``first``."""
        now = member.join(self.label, "id")
        two = now.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("id").alias("first"), F.min("n").alias("least")).where("c1 < c2").select("key", "first", "least")
        # As a table, it is met by a plain shuffle of the members, of which Spark can split a much larger part; behind an aggregate it can't.
        now = now.join(materialise(two, "two"), "key")
        if "at" in member.columns:  # too far on in its order even for the least partner in the group that could be a link
            t = self.threshold
            now = now.where((F.col("n") - F.col("at")) * (1 + t) >= t * (F.col("n") + F.greatest("least", t * F.col("n"))) - 1e-6)
        return materialise(now.drop("least"), "groups")

    def pairs(self, led: DataFrame, leaders: DataFrame) -> DataFrame:
        """(a, b) of leaders and other members of their groups, of other classes and of sizes that allow a link. A pair that is judged already is left out."""
        fits = (F.least("n", "na") >= self.threshold * F.greatest("n", "na") - 1e-6) & (F.col("a") < F.col("id")) & (F.col("ca") != F.col("component"))
        chief = leaders.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), *([F.col("at").alias("at_a")] if "at" in led.columns else []))
        if "at" in led.columns:
            # If this is the first shingle that both have, no more than what follows it in either is common. (If it is not, the pair
            # is met at the first one too.)
            fits &= (F.least(F.col("n") - F.col("at"), F.col("na") - F.col("at_a"))) * (1 + self.threshold) >= self.threshold * (F.col("n") + F.col("na")) - 1e-6
        met = led.join(chief, "key").where(fits).groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("groups"))
        return met if self.judged is None else met.join(self.judged, ["a", "b"], "left_anti")

    def judge(self, pairs: DataFrame) -> None:
        """Verify pairs, and merge the classes that links join."""
        judged = materialise(_verified(pairs.select("a", "b"), self.sets, self.threshold), "judged")
        own = judged.select("a", "b")
        self.judged = own if self.judged is None else self.judged.unionByName(own)
        c = self.label.select("id", "component")
        if judged.where("linked").isEmpty():
            return
        links = judged.where("linked").join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
        links = materialise(links, "links")
        if links.isEmpty():
            return
        new = components(links).toDF("component", "now")
        self.label = materialise(self.label.join(new, "component", "left").select("id", F.coalesce("now", "component").alias("component"), "n"), "labels")


def _prefixes(sets: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(key, id, at): for each text its shingles, the rarest first, as far as a partner at the threshold can do without them."""
    own = sets.join(ids, "id", "left_semi")
    flat = materialise(own.select("id", "n", F.explode("elements").alias("key")), "elements")
    often = flat.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    rare = flat.join(often, "key", "left").groupBy("id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "key"))).alias("e"))
    size = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    head = F.slice("e", F.lit(1), size.cast("int"))
    return rare.select("id", F.posexplode(head).alias("at", "x")).where("x.df > 1").select(F.col("x.key").alias("key"), "id", "at")


def text_key(text: Column) -> Column:
    """What tells apart rows that share an id."""
    return F.xxhash64(text.cast("string"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, class_id) of every row of ``docs`` (doc_id, text)."""
    with scratch(docs.sparkSession):
        return materialise(_near_duplicates(docs, threshold, k, rows), "classes", keep=True)


def _near_duplicates(docs: DataFrame, threshold: float, k: int, rows: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", text_key(F.col("text")))
    signed = materialise(sign(docs, k, rows), "signed")
    # A text is known by the least (doc_id, text_key) among its copies.
    texts = materialise(signed.groupBy("content").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.min_by("bands", F.struct("doc_id", "text_key")).alias("bands")), "texts")
    texts = texts.select("content", F.col("least.doc_id").alias("id"), F.col("least.text_key").alias("text_key"), "bands")
    known = texts.groupBy("id").agg(F.min("text_key").alias("text_key"), F.min_by("bands", "text_key").alias("bands"))
    member = known.select("id", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    member = materialise(member.join(shared.select("key"), "key").distinct(), "members")
    wanted = texts.groupBy("id").agg(F.min("text_key").alias("text_key")).join(member.select("id").distinct(), "id", "left_semi").withColumn("doc_id", F.col("id"))
    sets = materialise(_sets(docs.join(wanted, ["doc_id", "text_key"]).select("id", "text")).dropDuplicates(["id"]), "sets")
    tidy(docs.sparkSession)  # the texts that were shuffled for the sets are the bulk
    classes = _Classes(sets, threshold)
    for first in (True, False):
        now = classes.groups(member)
        pairs = classes.pairs(now, now.where("id = first"))
        if first:  # one link a text settles nearly all
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("groups", -F.col("a"))).alias("a"))
        classes.judge(pairs)
    rest = classes.groups(member).select("id").distinct()
    member, leaders = materialise(_prefixes(sets, rest, threshold), "prefixes"), 1
    while True:
        now = classes.groups(member)
        if now.isEmpty():
            break
        place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        top = now.where("id = first") if leaders < 4 else materialise(now.withColumn("place", place).where(F.col("place") <= leaders).drop("place"), "leaders")
        classes.judge(classes.pairs(now, top))
        member = materialise(now.join(top.select("key", "id"), ["key", "id"], "left_anti").select("key", "id", "at"), "prefixes")
        leaders = min(leaders * (2 if leaders < 4 else 4), LEADERS)
    named = texts.select("content", "id").join(classes.label.select("id", "component"), "id", "left").select("content", F.coalesce("component", "id").alias("class_id"))
    ranked = signed.select("doc_id", "text_key", "content").join(named, "content").select("doc_id", "text_key", "class_id").distinct()
    out = docs.select("doc_id", "text_key").join(ranked, ["doc_id", "text_key"], "left")
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"))
