"""A training corpus from raw documents: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``. ``run`` writes each stage's rows into
the shared folder and reads them again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import dart_minhash, debruijn, decontaminate, packing, quality
from lodestone.llm.shared import free_name, materialise, quoted, scratch, small_batches
from lodestone.llm.tokens import default_path

#: No SQL: tokenization and minhash classes can't be put so; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def _as_given(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` alone."""
    return rows.select(*map(quoted, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts have no words, so they go; null ids and repeated rows are judged by their own texts; an empty table gives no rows; all
    other columns, of whatever names, pass through.
    """
    small_batches(spark)
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id.

    Rows without an id stay; null texts and texts without words are classes of their own; rows equal in id and text become one (which of
    them, where other columns differ, is not defined); rows that share an id with different texts stay where that id is their class; an empty table
    gives no rows; other columns, of whatever names, pass through.
    """
    small_batches(spark)
    key, kept = (free_name(docs.columns, c) for c in ("text_key", "kept_id"))
    found = dart_minhash.near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias(kept), F.col("text_key").alias(key)).distinct()
    rows = docs.withColumn(key, dart_minhash.text_key(F.col("text")))
    stay = rows.join(found, [rows["doc_id"] == found[kept], rows[key].eqNullSafe(found[key])], "left_semi").dropDuplicates(["doc_id", key])
    return _as_given(stay.unionByName(rows.where("doc_id is null")), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that an earlier document has; a text may become empty. n_chars, where there is such a column, follows.

    Null texts stay null; rows without an id stay as they are; rows that share an id don't trim each other; repeated rows are trimmed
    alike; an empty table gives no rows; other columns, of whatever names, pass through.
    """
    small_batches(spark)
    out = debruijn.dedup_texts(docs)
    if "n_chars" in docs.columns:
        removed = F.col(quoted(out.columns[-1]))
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _as_given(out, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts have no hits and stay; rows with null or equal ids are judged by their own texts, repeated rows alike; empty tables on either side
    are legal; other columns, of whatever names, pass through.
    """
    small_batches(spark)
    key, bad_id, bad_key = (free_name(docs.columns, c) for c in ("text_key", "bad_id", "bad_key"))
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    rows = docs.withColumn(key, decontaminate.text_key(F.col("text")))
    return _as_given(rows.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & F.col(key).eqNullSafe(F.col(bad_key)), "left_anti"), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null and empty texts are one piece with the end id alone; null ids and repeated rows are packed once each; an empty table gives no rows;
    other columns are left behind.
    """
    small_batches(spark)
    return packing.best_fit(docs, default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
