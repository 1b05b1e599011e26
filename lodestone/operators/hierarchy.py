"""Hierarchies, inherited members, transitive dependencies and other graph questions.

Walks, whether each keeps a path of its own or all share one set of visited nodes, are loops of joins, each round cut off by a
checkpoint where the session has a folder for it.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

MAX_DEPTH = 5


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop in the folder that all executors share; only a local session without one gets a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return df.checkpoint(eager=True)


def walk(edges: DataFrame, root: str, depth: int = MAX_DEPTH, down: bool = False) -> DataFrame:
    """(depth, node, path): every path from ``root``, up to ``depth`` edges. ``edges``: (child, parent).

    A node that lies on the path already is not entered again, so cycles end. A shared node shows on each path to it.
    Recursive SQL would stop with an error at a million paths or a hundred levels.
    """
    here, there = ("parent", "child") if down else ("child", "parent")
    hops = _cut(edges.select(F.col(here).alias("node"), F.col(there).alias("_to")).distinct())
    out = front = edges.sparkSession.range(1).select(F.lit(0).alias("depth"), F.lit(root).alias("node"), F.array(F.lit(root)).alias("path"))
    for d in range(1, max(1, depth) + 1):
        front = front.join(hops, "node").where(~F.array_contains("path", F.col("_to")))
        front = _cut(front.select(F.lit(d).alias("depth"), F.col("_to").alias("node"), F.array_append("path", F.col("_to")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
        if d % 16 == 0:  # a union of few tables, however long the way
            out = _cut(out)
    return out


def resolved(tree: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``is_external``: no symbol has the node's name."""
    known = symbols.select(F.lower("name").alias("_n")).distinct()
    return tree.join(known, F.lower("node") == F.col("_n"), "left").withColumn("is_external", F.col("_n").isNull()).drop("_n")


def truncated(edges: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """(node, path, hidden): children below the last level that were not walked."""
    last = tree.where(F.col("depth") == depth)
    met = last.join(edges, F.col("node") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
    return met.groupBy("node", "path").agg(F.count("*").alias("hidden"))


def reach(edges: DataFrame | Callable[[DataFrame], DataFrame], roots: DataFrame, depth: int | None = MAX_DEPTH) -> DataFrame:
    """(node, depth): the least number of edges from any of ``roots`` (node); each node once. Without a ``depth``, all that can be reached.

    ``edges``: (src, dst), which are computed once; or a function that gives those of a front (node), so that edges of other nodes are never made.
    """
    seen = front = roots.select("node").distinct().withColumn("depth", F.lit(0))
    if isinstance(edges, DataFrame):
        hops = _cut(edges.select("src", "dst").distinct())
        edges = lambda f: hops.join(f.select(F.col("node").alias("src")), "src", "left_semi")
    for d in itertools.count(1) if depth is None else range(1, max(1, depth) + 1):
        front = edges(front).select(F.col("dst").alias("node")).distinct()
        front = _cut(front.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if d % 16 == 0:  # a union of few tables, however long the way
            seen = _cut(seen)
    return seen


def first_types(types: DataFrame, order: list) -> DataFrame:
    """Of the types of each name, in whatever case, the first by ``order``; adds it as ``node``."""
    n = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*order))
    return types.withColumn("_n", n).where("_n = 1").drop("_n").withColumn("node", F.lower("name"))


def inherited(members: DataFrame, edges: DataFrame, root: str, depth: int | None = None) -> DataFrame:
    """(name, kind, from_owner): members of all ancestors that ``root`` itself does not define. ``members``: (owner, name, kind).

    Ancestors do not hide each other.
    """
    above = reach(edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")), edges.sparkSession.createDataFrame([(root,)], "node string"), depth).where("depth > 0")
    own = members.where(F.col("owner") == root).select("name", "kind")
    got = members.join(above.select(F.col("node").alias("owner")), "owner", "left_semi")
    return got.join(own, ["name", "kind"], "left_anti").select("name", "kind", F.col("owner").alias("from_owner"))


def overrides(members: DataFrame, children: DataFrame, name: str) -> DataFrame:
    """Members called ``name`` in ``children`` (owner)."""
    return members.where(F.col("name") == name).join(children.select("owner").distinct(), "owner", "left_semi")


def most_extended(edges: DataFrame, n: int = 10) -> DataFrame:
    """(parent, packages, implementations): by distinct packages of the children, then by their number. ``edges``: (child, parent, package)."""
    out = edges.groupBy("parent").agg(F.count_distinct("package").alias("packages"), F.count("*").alias("implementations"))
    return out.orderBy(F.desc("packages"), F.desc("implementations"), "parent").limit(n)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of all vertices; multi-edges count."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def sources(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("n_in = 0").select("node")


def sinks(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("n_out = 0").select("node")


#: Graphs of so many edges are settled on the driver: package graphs are far below it, and long chains need no rounds of joins there.
SMALL = 200_000


def _small(edges: DataFrame) -> list[tuple] | None:
    rows = edges.limit(SMALL + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= SMALL else None


def _levels(edges: list[tuple]) -> dict | None:
    """The longest distance of each vertex to a sink; None if there is a cycle."""
    above, left, level = defaultdict(list), defaultdict(int), {}
    for src, dst in edges:
        above[dst].append(src)
        left[src] += 1
        level[src] = level[dst] = 0
    ready, done = [v for v in level if not left[v]], 0
    while ready:
        v = ready.pop()
        done += 1
        for u in above[v]:
            level[u] = max(level[u], level[v] + 1)
            left[u] -= 1
            if not left[u]:
                ready.append(u)
    return level if done == len(level) else None


def is_acyclic(edges: DataFrame) -> bool:
    """Whether a graph has no cycle. Large ones are peeled round by round: an edge stays while something leads into its source and out of its target."""
    left = _cut(edges.select("src", "dst").distinct())
    if (small := _small(left)) is not None:
        return _levels(small) is not None
    n = left.count()
    while n:
        after = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        after = _cut(after.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        m = after.count()
        if m == n:
            return False
        left, n = after, m
    return True


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest distance to a sink, of an acyclic graph; one with a cycle raises an error."""
    e = _cut(edges.select("src", "dst").distinct())
    if (small := _small(e)) is not None:
        if (found := _levels(small)) is None:
            raise ValueError("the graph has a cycle")
        schema = StructType([StructField("node", e.schema["src"].dataType), StructField("level", IntegerType())])
        return e.sparkSession.createDataFrame(list(found.items()), schema)
    if not is_acyclic(e):
        raise ValueError("the graph has a cycle")
    out = front = sinks(e).withColumn("level", F.lit(0))
    for d in itertools.count(1):
        front = _cut(e.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct().withColumn("level", F.lit(d)))
        if front.isEmpty():
            return out
        out = _cut(out.unionByName(front).groupBy("node").agg(F.max("level").alias("level")))
