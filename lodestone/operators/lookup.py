"""Symbol lookup, filters, rankings and limits.

``symbols``: name, kind, path, line, package, parents, type_param_parents, signature, annotations. All
orders end in (path, line, name), so results are total orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TYPE_KINDS = ("class", "trait", "object", "enum")
LAST = ("path", "line", "name")


def kept(
    symbols: DataFrame, kind: str | None = None, no_tests: bool = False, prefix: str | None = None, exclude: str | None = None, package: str | None = None, types_only: bool = False
) -> DataFrame:
    """The shared filters; each is a plain predicate that reaches the scan."""
    if kind:
        symbols = symbols.where(F.lower("kind") == kind.lower())
    if types_only:
        symbols = symbols.where(F.lower("kind").isin(*TYPE_KINDS))
    if package:
        symbols = symbols.where(T.in_package(F.col("package"), package))
    if no_tests:
        symbols = symbols.where(~T.is_test_path(F.col("path")))
    if prefix:
        symbols = symbols.where(F.col("path").startswith(prefix.lstrip("/")))
    if exclude:
        symbols = symbols.where(~F.col("path").startswith(exclude.lstrip("/")))
    return symbols


def first_stage(stages: list[DataFrame]) -> DataFrame:
    """Rows of the first stage that has any, decided inside one plan: a stage number and its minimum."""
    tagged = [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    least = every.agg(F.min("_stage").alias("_least"))
    return every.join(F.broadcast(least), F.col("_stage") == F.col("_least")).drop("_stage", "_least")


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Definitions of a plain or dotted name. Dotted: qualified name, else package suffix, else the files of the owner type."""
    low = name.lower()
    if "." not in low:
        return symbols.where(F.lower("name") == low)
    owner, _, last = low.rpartition(".")
    exact = symbols.where(F.lower(F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), "name")) == low)
    suffix = symbols.where((F.lower("name") == last) & F.lower("package").endswith(owner))
    owners = by_name(symbols, owner).where(F.lower("kind").isin(*TYPE_KINDS)).select("path").distinct()
    nested = symbols.where(F.lower("name") == last).join(owners, "path", "left_semi")
    return first_stage([exact, suffix, nested])


def type_edges(symbols: DataFrame) -> DataFrame:
    """(child_name, child_path, child_line, parent_lc, edge_kind) of direct and type-argument parents."""
    one = lambda c, kind: symbols.select(F.col("name").alias("child_name"), F.col("path").alias("child_path"), F.col("line").alias("child_line"), F.explode(c).alias("p"), F.lit(kind).alias("edge_kind"))
    both = one("parents", "direct").unionByName(one("type_param_parents", "type_param"))
    return both.withColumn("parent_lc", F.lower("p")).drop("p")


def implementations(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols with ``name`` among their parents; of a dotted name the owner must resolve, then the last part counts."""
    last = name.lower().rpartition(".")[2]
    has = lambda c: F.exists(c, lambda p: F.lower(p) == last)
    hit = symbols.where(has("parents") | has("type_param_parents")).dropDuplicates(["name", "path", "line"])
    if "." in name:
        hit = hit.join(F.broadcast(by_name(symbols, name).limit(1).select(F.lit(1).alias("_one"))))
        hit = hit.drop("_one")
    return hit


def expanded(symbols: DataFrame, first: DataFrame, root: str, levels: int, n: int, keep=lambda rows: rows) -> DataFrame:
    """Implementations of implementations, level by level: (depth, place, of, name, kind, path, line, package, leaf).

    ``first``: the implementations of ``root`` (package.name, lower case). Of each row the first ``n`` implementations that ``keep`` leaves go on, and of those the types. ``place`` tells
    a row of the tree, ``of`` the one above it. A type that lies on the path already is listed as a ``leaf``, without any below it. No level has more than ``n`` rows for each row above.
    """
    known = F.concat(F.lower("package"), F.lit("."), F.lower("name"))
    cols = ["name", "kind", "path", "line", "package"]
    tell = F.concat_ws("\x1f", "of", "path", F.lpad(F.col("line").cast("string"), 9, "0"), "name")

    def level(rows: DataFrame, depth: int) -> DataFrame:
        some = per_group(rows, ["of"], [F.col(c) for c in LAST], n).where(F.lower("kind").isin(*TYPE_KINDS))
        return some.withColumns({"depth": F.lit(depth), "place": tell, "key": known, "leaf": F.array_contains("above", known)})

    now = level(first.select(*cols).withColumns({"of": F.lit(""), "above": F.array(F.lit(root))}), 1)
    out = now
    edges = type_edges(symbols).select(F.col("child_name").alias("name"), F.col("child_path").alias("path"), F.col("child_line").alias("line"), "parent_lc").distinct()
    below = keep(symbols).select(*cols).distinct().join(edges, ["name", "path", "line"])
    for depth in range(2, levels + 1):
        up = now.where("not leaf").select(F.col("place").alias("of"), F.array_append("above", F.col("key")).alias("above"), F.lower("name").alias("parent_lc"))
        now = level(below.join(up, "parent_lc").select(*cols, "of", "above"), depth)
        out = out.unionByName(now)
    return out.select("depth", "place", "of", *cols, "leaf")


def companion(symbols: DataFrame, of: DataFrame) -> DataFrame:
    """For each class, trait or enum the object of its name, package and file, and the other way round: the first."""
    a = of.select("name", "package", "path", F.lower("kind").alias("k"), F.col("line").alias("of_line"))
    b = symbols.select("name", "package", "path", "line", "kind", "signature")
    met = a.join(b, ["name", "package", "path"]).where(F.when(F.col("k") == "object", F.lower("kind").isin("class", "trait", "enum")).otherwise(F.lower("kind") == "object"))
    first = F.row_number().over(Window.partitionBy("name", "package", "path", "of_line").orderBy("line"))
    return met.withColumn("_n", first).where("_n = 1").drop("_n", "k")


def search(symbols: DataFrame, query: str, popularity: DataFrame | None = None, exact: bool = False, prefix: bool = False) -> DataFrame:
    """Symbols by search tier and rank. ``popularity``: (name_lc, imports), how often a name is imported."""
    tier = T.search_tier(F.col("name"), query)
    hit = symbols.withColumn("tier", tier).where(F.col("tier").isNotNull()).dropDuplicates(["name", "path", "line"])
    if exact or prefix:
        hit = hit.where(F.col("tier") <= (1 if exact else 2))
    if popularity is None:
        return hit.withColumn("imports", F.lit(0).cast("long"))
    return hit.join(popularity.withColumnRenamed("name_lc", "_n"), F.lower("name") == F.col("_n"), "left").drop("_n").fillna(0, ["imports"])


def _cases(kind: Column, ranks: dict[str, int], other: int) -> Column:
    return T.ranked(F.lower(kind), {k: r for k, r in ranks.items()}) if other == len(ranks) else F.coalesce(*[F.when(F.lower(kind) == k, r) for k, r in ranks.items()], F.lit(other))


def search_order() -> list[Column]:
    """Tier; then for tiers 1 to 4 kind, test, library, popularity and path length, for camel case the name's length."""
    plain = F.col("tier") < 5
    kind = _cases(F.col("kind"), {"class": 0, "trait": 0, "enum": 0, "object": 1, "def": 2, "val": 2, "type": 2}, 3)
    of = lambda c: F.when(plain, c)
    return [
        F.col("tier"), of(kind), of(T.is_test_path(F.col("path").cast("string"))), of(T.std_rank(F.col("package"))), of(-F.col("imports")),
        of(F.length(F.col("path").cast("string"))), F.when(~plain, F.length("name")), *map(F.col, LAST),
    ]


def definition_order() -> list[Column]:
    kind = _cases(F.col("kind"), {"class": 0, "trait": 0, "object": 0, "enum": 0, "type": 1, "given": 1}, 2)
    path = F.col("path").cast("string")
    return [kind, T.is_test_path(path), T.std_rank(F.col("package")), F.length(path), *map(F.col, LAST)]


def member_order() -> list[Column]:
    kind = _cases(F.col("kind"), {"class": 0, "trait": 0, "object": 0, "enum": 0, "def": 1, "val": 2, "var": 2, "type": 3}, 4)
    return [kind, F.col("ord")]


def package_order() -> list[Column]:
    return [_cases(F.col("kind"), {"trait": 0, "class": 1, "enum": 2, "object": 3}, 4), *map(F.col, ("name", "path", "line"))]


def file_search(paths: DataFrame, query: str) -> DataFrame:
    """Paths whose file name without its ending matches, by tier; camel case by length of the path."""
    base = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    q = query.lower()
    low = F.lower(base)
    tier = F.when(low == q, 1).when(low.startswith(q), 2).when(low.contains(q), 3).when(T.camel_match(base, query), 5)
    hit = paths.select("path").distinct().withColumn("tier", tier).where(F.col("tier").isNotNull())
    return hit.orderBy("tier", F.when(F.col("tier") == 5, F.length("path")), "path")


def limited(rows: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """The first ``n`` rows of an ordered frame; 0 is no limit. With an order before it Spark runs one top-k."""
    if offset:
        rows = rows.offset(offset)
    return rows.limit(n) if n else rows


def per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark cuts groups before the shuffle (WindowGroupLimit), so a hot key costs ``n`` rows a task."""
    if not n:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def package_match(symbols: DataFrame, wanted: str) -> DataFrame:
    """(package): the best match of a package name: equal, else last part, else contained; of those the one with most distinct names."""
    low, p = wanted.lower(), F.lower("package")
    tier = F.when(p == low, 0).when(p.endswith(f".{low}"), 1).when(p.contains(low), 2)
    sized = symbols.withColumn("tier", tier).where(F.col("tier").isNotNull()).groupBy("package", "tier").agg(F.count_distinct("name").alias("names"))
    return sized.orderBy("tier", F.desc("names"), "package").limit(1).select("package")


def annotated(symbols: DataFrame, annotation: str) -> DataFrame:
    low = annotation.removeprefix("@").lower()
    return symbols.where(F.exists("annotations", lambda a: F.lower(a) == low))
