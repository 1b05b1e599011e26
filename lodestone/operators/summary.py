"""Counts, differences of snapshots, set operations, entry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parents by which a type is a test suite.
TEST_PARENTS = (
    "FunSuite", "AnyFunSuite", "FlatSpec", "AnyFlatSpec", "WordSpec", "AnyWordSpec", "FreeSpec", "AnyFreeSpec", "PropSpec", "FeatureSpec", "Suite", "Specification", "FunSpec",
)


def count_by(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """(key, count), the most first; blank keys are dropped."""
    out = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), key).limit(n) if n else out


def totals(symbols: DataFrame) -> DataFrame:
    """One row: files, symbols and packages."""
    return symbols.agg(F.count_distinct("path").alias("files"), F.count("*").alias("symbols"), F.count_distinct(F.when(F.col("package") != "", F.col("package"))).alias("packages"))


def sub_packages(symbols: DataFrame, package: str) -> DataFrame:
    """(sub_package, symbol_count) below a package: all that follows its name, ``(root)`` for itself."""
    inside = symbols.where((F.col("package") == package) | F.col("package").startswith(f"{package}."))
    label = F.when(F.col("package") == package, "(root)").otherwise(F.substring("package", len(package) + 2, 1 << 20))
    return inside.groupBy(label.alias("sub_package")).agg(F.count("*").alias("symbol_count"))


def difference(old: DataFrame, new: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """(keys, change): added, removed, or modified where any of ``payload`` differs. One row a key in each snapshot: the first by payload."""
    one = lambda df, side: df.groupBy(*keys).agg(F.min(F.struct(*payload)).alias(side))
    both = one(old, "o").join(one(new, "n"), keys, "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change")


def first_branch(branches: list[tuple[str, DataFrame]], key: list[str], order: list[str]) -> DataFrame:
    """Union of branches in priority order; a key that several have belongs to the first (``category`` tells which)."""
    every = None
    for rank, (name, df) in enumerate(branches):
        df = df.withColumns({"category": F.lit(name), "_rank": F.lit(rank)})
        every = df if every is None else every.unionByName(df)
    n = F.row_number().over(Window.partitionBy(*key).orderBy("_rank", *order))
    return every.withColumn("_n", n).where("_n = 1").drop("_n", "_rank")


def entrypoints(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """Where programs begin: @main, extends App, objects with a def main (at the member's line), test suites."""
    parent = lambda names: F.exists("parents", lambda p: F.lower(p).isin(*[n.lower() for n in names]))
    cols = ["name", "kind", "path", "line", "package"]
    mains = members.where("name = 'main' and kind = 'def' and owner_kind = 'object'").select("path", F.col("owner").alias("name"), F.col("line").alias("main_line"))
    with_main = symbols.where("kind = 'object'").join(mains, ["path", "name"]).withColumn("member_line", F.col("main_line"))
    none = F.lit(None).cast("int").alias("member_line")
    branches = [
        ("MainAnnotation", symbols.where(F.exists("annotations", lambda a: a == "main")).select(*cols, none)),
        ("ExtendsApp", symbols.where(parent(["App"])).select(*cols, none)),
        ("MainMethod", with_main.select(*cols, "member_line")),
        ("TestSuite", symbols.where(parent(TEST_PARENTS)).select(*cols, none)),
    ]
    return first_branch(branches, ["name", "path", "line"], ["path"])


def suites(tests: DataFrame) -> DataFrame:
    """One row: suites, literal tests and dynamic sites."""
    return tests.agg(F.count_distinct("path", "suite", "suite_line").alias("suites"), F.count_if(~F.col("is_dynamic")).alias("tests"), F.count_if("is_dynamic").alias("dynamic_sites"))


def api_totals(edges: DataFrame) -> DataFrame:
    """One row: edges and packages with dependencies of a package graph."""
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("packages"))
