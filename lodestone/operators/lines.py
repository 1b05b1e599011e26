"""Line scans, tokens and regex search over texts.

Roles: ``path`` names a text, ``line`` counts from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def lines(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line, text) of every line; nothing is shuffled."""
    cut = texts.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "text"))
    return cut.select("path", (F.col("at") + 1).alias("line"), "text")


def tokens(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Distinct identifier tokens of each text: made distinct inside the row, so without a shuffle."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(T.TOKEN), F.lit(0)))
    return texts.select(F.col(path).alias("path"), F.explode(found).alias("token"))


def screened(texts: DataFrame, word: str, path: str = "path", text: str = "text") -> DataFrame:
    """Texts that hold ``word`` as a token. Names that are never stored as tokens are not screened."""
    if not word.isidentifier() or len(word) < 2:
        return texts
    # One token is a run of letters, digits and underscores that does not begin with a digit: what stands before it ends no such run.
    whole = rf"(?:^|[^\p{{L}}\p{{Nd}}_])\p{{Nd}}*{word}(?![\p{{L}}\p{{Nd}}_])"
    return texts.where(F.col(text).contains(word) & F.col(text).rlike(whole))


def grep(rows: DataFrame, pattern: str) -> DataFrame:
    """Lines in which ``pattern`` is found: one row each, trimmed."""
    return rows.where(F.col("text").rlike(pattern)).select("path", "line", F.trim("text").alias("text"))


def grep_count(rows: DataFrame, pattern: str) -> DataFrame:
    """One row: matching lines and files that have any."""
    return rows.where(F.col("text").rlike(pattern)).agg(F.count("*").alias("matches"), F.count_distinct("path").alias("files"))


def in_spans(rows: DataFrame, spans: DataFrame, extra: list[str]) -> DataFrame:
    """Lines inside spans (path, start_line, end_line, …): an equi-join on path with a range as residual.

    Spans of one text are few, so the range costs no more than the lines of that text times its spans.
    """
    own = spans.select(F.col("path").alias("_path"), F.col("start_line").alias("_from"), F.col("end_line").alias("_to"), *(F.col(c).alias(f"_span_{c}") for c in extra))
    met = rows.join(own, (F.col("path") == F.col("_path")) & F.col("line").between(F.col("_from"), F.col("_to")))
    return met.select("path", "line", "text", *(F.col(f"_span_{c}").alias(c) for c in extra))


def with_context(rows: DataFrame, hits: DataFrame, n: int) -> DataFrame:
    """Each hit (path, line) with its ``n`` lines before and after, and which of them is the hit.

    Hits are spread over the lines they want, so the join is on equality.
    """
    want = hits.select("path", F.col("line").alias("hit"), F.explode(F.sequence(F.col("line") - n, F.col("line") + n)).alias("line"))
    return rows.join(want, ["path", "line"]).select("path", "hit", "line", "text", (F.col("line") == F.col("hit")).alias("is_match"))


def filtered(rows: DataFrame, path: Column, no_tests: bool = False, prefix: str | None = None, exclude: str | None = None) -> DataFrame:
    """The shared path filters."""
    if no_tests:
        rows = rows.where(~T.is_test_path(path))
    if prefix:
        rows = rows.where(path.startswith(prefix.lstrip("/")))
    if exclude:
        rows = rows.where(~path.startswith(exclude.lstrip("/")))
    return rows
