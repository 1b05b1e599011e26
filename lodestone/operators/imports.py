"""Imports: parsing, who imports a name, popularity, API surface, package graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import lines, screened


def parsed(raw: DataFrame) -> DataFrame:
    """Adds pkg, names and is_wildcard to rows with ``import_text``; the parse is one set of column expressions."""
    parts = T.import_parts(F.col("import_text"))
    return raw.withColumns(parts)


def named(imports: DataFrame) -> DataFrame:
    """(path, pkg, name) of every name imported by name."""
    return imports.select("path", "pkg", F.explode("names").alias("name"))


def popularity(imports: DataFrame) -> DataFrame:
    """(name_lc, imports): how often a name is imported by name."""
    return named(imports).groupBy(F.lower("name").alias("name_lc")).agg(F.count("*").alias("imports"))


def importers(texts: DataFrame, name: str, symbol_packages: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, line, context) of import lines that bring ``name`` in: by name, or by a wildcard of one of its packages."""
    own = lines(screened(texts, name)).where(F.trim("text").startswith("import ") & T.has_word(F.col("text"), name))
    wild = imports.where("is_wildcard").join(symbol_packages.select(F.col("package").alias("pkg")).distinct(), "pkg", "left_semi")
    bare = lambda c: F.regexp_replace(F.trim(c), r"\s*;$", "")  # noqa: E731  as import texts have no end mark
    wild = wild.select("path", bare("import_text").alias("bare")).distinct()
    by_text = lines(texts.join(wild.select("path").distinct(), "path", "left_semi")).select("path", "line", F.trim("text").alias("context"), bare("text").alias("bare")).join(wild, ["path", "bare"], "left_semi")
    return own.select("path", "line", F.trim("text").alias("context")).unionByName(by_text.select("path", "line", "context")).dropDuplicates(["path", "line"])


def api_surface(symbols: DataFrame, package: str, imports: DataFrame, files: DataFrame, used_by: str | None = None) -> DataFrame:
    """(name, kind, path, line, package, importer_count): names of a package and how many files of other packages import them.

    A wildcard import counts for every name. ``files``: (path, package). Names without importers keep the count 0.
    """
    own = symbols.where(F.col("package") == package)
    one = own.groupBy("name").agg(F.min(F.struct("path", "line", "kind")).alias("s")).select("name", "s.kind", "s.path", "s.line", F.lit(package).alias("package"))
    outside = imports.where(F.col("pkg") == package).join(files.withColumnRenamed("package", "from_package"), "path", "left")
    outside = outside.withColumn("from_package", F.coalesce("from_package", F.lit(""))).where(F.col("from_package") != package)
    if used_by:
        outside = outside.where(F.lower("from_package").contains(used_by.lower()))
    # Files with a wildcard count for every name: their number is added, so names and files are never paired.
    wild = outside.where("is_wildcard").select("path").distinct()
    by_name = outside.select("path", F.explode("names").alias("name")).join(wild, "path", "left_anti")
    count = by_name.groupBy("name").agg(F.count_distinct("path").alias("named"))
    every = F.broadcast(wild.agg(F.count("*").alias("every")))  # one row
    out = one.join(count, "name", "left").join(every)
    return out.withColumn("importer_count", F.coalesce("named", F.lit(0)) + F.col("every")).drop("named", "every")


def package_graph(imports: DataFrame, files: DataFrame, focus: str | None = None) -> DataFrame:
    """Distinct (src, dst) of packages: a file's package imports from another package of the index.

    With ``focus``, edges among that package and its direct neighbours.
    """
    known = files.select(F.col("package").alias("dst")).where("dst <> ''").distinct()
    edges = (
        imports.select("path", F.regexp_extract(F.regexp_replace(F.trim("import_text"), r"^import\s+", ""), r"^(.*)\.[^.]*$", 1).alias("dst"))
        .join(files.select("path", F.col("package").alias("src")), "path")
        .where("src <> dst and src <> ''")
        .join(known, "dst", "left_semi")
        .select("src", "dst")
        .distinct()
    )
    if focus is None:
        return edges
    touching = edges.where((F.col("src") == focus) | (F.col("dst") == focus))
    near = touching.select(F.explode(F.array("src", "dst")).alias("p")).distinct()
    return edges.join(near.withColumnRenamed("p", "src"), "src", "left_semi").join(near.withColumnRenamed("p", "dst"), "dst", "left_semi")
