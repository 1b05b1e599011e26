"""References to a name: screen, scan, category, confidence, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import lines, screened


def references(texts: DataFrame, name: str, strict: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """(path, line, context, alias): lines that have ``name``, or its alias in the texts that import it under one.

    One row a line; a line that has the name itself is no alias row. ``aliases``: (path, original, alias).
    """
    own = lines(screened(texts, name)).where(T.has_word(F.col("text"), name, strict))
    own = own.select("path", "line", F.trim("text").alias("context"), F.lit(None).cast("string").alias("alias"))
    if aliases is None:
        return own
    # One alias a text, the last by name; the aliases of one name are few, so this side is small.
    renamed = aliases.where(F.col("original") == name).groupBy("path").agg(F.max("alias").alias("alias"))
    inside = T._IN_NAME if strict else T._IN_WORD
    word = F.concat(F.lit(f"(?<![{inside}])\\Q"), F.col("alias"), F.lit(f"\\E(?![{inside}])"))
    rest = lines(texts.join(renamed.select("path"), "path", "left_semi")).join(renamed, "path")
    via = rest.where(F.expr("contains(text, alias)")).where(F.regexp_like("text", word) & ~T.has_word(F.col("text"), name, strict))
    return own.unionByName(via.select("path", "line", F.trim("text").alias("context"), "alias"))


def categorised(refs: DataFrame, name: str) -> DataFrame:
    return refs.withColumn("category", T.category(F.col("context"), name))


def confident(refs: DataFrame, name: str, packages: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds ``confidence``. ``packages``: (package) of the definitions; ``files``: (path, package); ``imports``: (path, import_text, pkg, is_wildcard)."""
    n = T.quoted(name)
    target = packages.distinct()
    near = files.join(target, "package", "left_semi").select("path", F.lit(True).alias("same"))
    named = imports.where(F.col("import_text").rlike(rf"\.{n}|\{{{n}\}}|, {n}|{n},")).groupBy("path").agg(F.lit(True).alias("named"))
    wild = imports.where("is_wildcard").join(target.withColumnRenamed("package", "pkg"), "pkg", "left_semi").groupBy("path").agg(F.lit(True).alias("wild"))
    level = F.when(F.col("same") | F.col("named") | F.col("alias").isNotNull(), "High").when(F.col("wild"), "Medium").otherwise("Low")
    return refs.join(near, "path", "left").join(named, "path", "left").join(wild, "path", "left").withColumn("confidence", level).drop("same", "named", "wild")


def per_category(refs: DataFrame) -> DataFrame:
    """Counts of categories that occur."""
    return refs.groupBy("category").agg(F.count("*").alias("count"))


def per_file(refs: DataFrame, n: int | None = None) -> DataFrame:
    """Counts of files, the most first; ties by path. A top-k, not a sort, where ``n`` is given."""
    out = refs.groupBy("path").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "path")
    return out.limit(n) if n else out


def flat_order(refs: DataFrame) -> DataFrame:
    return refs.orderBy(T.ranked(F.col("confidence"), T.CONFIDENCE_ORDER), "path", "line")


def coverage(refs: DataFrame, is_test) -> DataFrame:
    """One row: references in test texts and how many texts have them. ``is_test``: a column."""
    return refs.where(is_test).agg(F.count("*").alias("reference_count"), F.count_distinct("path").alias("test_file_count"))
