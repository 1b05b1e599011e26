"""Text predicates and scalar functions as Column builders. No Python runs on the executors here.

Regular expressions are those of Java, which Spark's ``rlike`` uses.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What bounds a word: anything but a letter or a decimal digit; in strict matching also neither ``_`` nor ``$``.
_IN_WORD, _IN_NAME = r"\p{L}\p{Nd}", r"\p{L}\p{Nd}_$"
#: An identifier token of two characters or more.
TOKEN = r"[\p{L}_][\p{L}\p{Nd}_]+"

#: Categories of references in the order of their tests, and the order in which they are shown.
CATEGORIES = ("Definition", "ExtendedBy", "ImportedBy", "Comment", "UsedAsType", "Usage")
DISPLAY_ORDER = {"Definition": 0, "ExtendedBy": 1, "ImportedBy": 2, "UsedAsType": 3, "Usage": 4, "Comment": 5}
CONFIDENCE_ORDER = {"High": 0, "Medium": 1, "Low": 2}


def quoted(text: str) -> str:
    """``text`` as a pattern that matches it alone, in Java, Python and RE2."""
    return re.sub(r"[^\w\s]", lambda m: f"\\{m[0]}" if m[0].isascii() else m[0], text)


def word_pattern(word: str, strict: bool = False) -> str:
    inside = _IN_NAME if strict else _IN_WORD
    return f"(?<![{inside}]){quoted(word)}(?![{inside}])"


def has_word(text: Column, word: str, strict: bool = False) -> Column:
    """Whether ``word`` occurs with a boundary on both sides; the cheap substring test comes first."""
    return text.contains(word) & text.rlike(word_pattern(word, strict))


def camel_pattern(query: str) -> str:
    """Pattern of the greedy camel-case match: each character matches at once, or at the next segment start.

    Atomic groups keep the regex engine from going back, as a greedy scan does not either.
    """
    step = "".join(rf"(?>(?i:{quoted(c)})|[\s\S]+?(?:(?=\p{{Lu}})|(?<=_))(?i:{quoted(c)}))" for c in query)
    return f"^{step}"


def camel_match(name: Column, query: str) -> Column:
    return name.rlike(camel_pattern(query)) if len(query) >= 2 else F.lit(False)


def search_tier(name: Column, query: str) -> Column:
    """1 exact, 2 prefix, 3 contains, 4 the query ends with the name, 5 camel case; null for no match."""
    q, low = query.lower(), F.lower(name)
    return (
        F.when(low == q, 1)
        .when(low.startswith(q), 2)
        .when(low.contains(q), 3)
        .when((F.length(name) >= 3) & (F.length(name) > len(query) // 2) & F.lit(q).endswith(low), 4)
        .when(camel_match(name, query), 5)
    )


def category(line: Column, name: str) -> Column:
    """What kind of reference to ``name`` a line makes; the first test that holds decides."""
    n, text = quoted(name), F.trim(line)
    word = text.rlike(word_pattern(name))
    declares = text.rlike(rf"(trait|class|object|enum|type) {n}") | text.rlike(rf"given\s+\w*\s*{n}")
    return (
        F.when(text.rlike(r"^(trait|class|object|enum|given|type|def|val|var)\s") & word & declares, "Definition")
        .when(text.rlike(r"\b(extends|with)\b") & word, "ExtendedBy")
        .when(text.startswith("import "), "ImportedBy")
        .when(text.startswith("//") | text.startswith("/*") | text.startswith("*"), "Comment")
        .when(text.rlike(rf":\s*{n}|\[{n}"), "UsedAsType")
        .otherwise("Usage")
    )


def ranked(value: Column, order: dict[str, int]) -> Column:
    out = F.lit(len(order))
    for name, rank in order.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def std_rank(package: Column) -> Column:
    """2 for java and javax packages, 1 for scala, else 0."""
    low = F.lower(package)
    of = lambda p: (low == p) | low.startswith(f"{p}.")
    return F.when(of("java") | of("javax"), 2).when(of("scala"), 1).otherwise(0)


def in_package(package: Column, wanted: str) -> Column:
    return (package == wanted) | package.startswith(f"{wanted}.")


def is_test_path(path: Column) -> Column:
    """Paths of test sources: by folder, by benchmark prefix, or by file name."""
    return path.rlike(r"(^|/)(test|tests|testing)/|(^|/)bench-|(Test|Spec|Suite)\.(scala|java)$|\.test\.scala$")


def returns(signature: Column, wanted: str) -> Column:
    """What follows the last ``:`` of a signature contains ``wanted``, whatever the case."""
    return signature.contains(":") & F.lower(F.substring_index(signature, ":", -1)).contains(wanted.lower())


def takes(signature: Column, wanted: str) -> Column:
    """What stands between the first ``(`` and the last ``)`` contains ``wanted``, whatever the case."""
    return F.lower(F.regexp_extract(signature, r"\([\s\S]*\)", 0)).contains(wanted.lower())


def import_parts(text: Column) -> dict[str, Column]:
    """Package, names and wildcard of one import; renamed names keep what they are in the package."""
    body = F.trim(F.regexp_replace(F.trim(text), r"^import\s+|;$", ""))
    braces = body.contains("{")
    package = F.when(braces, F.regexp_replace(F.substring_index(body, "{", 1), r"\.\s*$", "")).otherwise(F.regexp_extract(body, r"^(.*)\.[^.]*$", 1))
    inner = F.regexp_extract(body, r"\{([^}]*)\}", 1)
    items = F.when(braces, F.transform(F.split(inner, ","), F.trim)).otherwise(F.array(F.regexp_replace(body, r"^.*\.", "")))
    plain = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*$|\s*=>.*$", "")))
    wild = F.exists(plain, lambda x: x.isin("_", "*", "given"))
    names = F.filter(plain, lambda x: (x != "") & ~x.isin("_", "*", "given"))
    return {"pkg": package, "names": names, "is_wildcard": wild}


def import_aliases(text: Column) -> Column:
    """Map from original to alias name of the renames in one import."""
    pairs = F.split(F.regexp_extract(text, r"\{([^}]*)\}", 1), ",")
    bare = F.when(text.contains("{"), pairs).otherwise(F.array(F.regexp_replace(text, r"^.*\.", "")))
    named = F.filter(bare, lambda x: x.rlike(r"^\s*\S+\s*(=>|\sas\s)\s*[^_\s]\S*\s*$"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^\s*(\S+?)\s*(=>|\sas\s)", 1).alias("k"), F.regexp_extract(x, r"(\S+)\s*$", 1).alias("v"))
    return F.map_from_entries(F.array_distinct(F.transform(named, entry)))


def java_regex_ok(spark: SparkSession, pattern: str) -> bool:
    """Whether Java accepts ``pattern``; asked of Spark itself, so no driver-side engine stands in for it."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception:
        return False
    return True


def repaired(spark: SparkSession, pattern: str) -> str:
    r"""A valid pattern stays; else ``\|`` becomes alternation; else all of it is taken literally."""
    if java_regex_ok(spark, pattern):
        return pattern
    other = pattern.replace(r"\|", "|")
    return other if other != pattern and java_regex_ok(spark, other) else quoted(pattern)


def grep_pattern(spark: SparkSession, patterns: list[str]) -> str:
    return "|".join(repaired(spark, p) for p in patterns)
