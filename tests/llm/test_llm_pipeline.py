"""Each stage of the pipeline on a hostile table: nulls, empties, repeats, equal ids, and columns named like a stage's own."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from lodestone.llm import quality
from pyspark.sql import functions as F
from test_llm_operators import WORD, brute_classes, brute_contamination, brute_repeats, hostile, ids

STAGES = dict(corpus_pipeline.STAGES)
ITEMS = [(1, None), (2, ""), (3, "alpha z z")]
CLASH = ["text_key", "kept_id", "bad_id", "bad_key", "spans", "n_removed", "id", "class_id", "TEXT_KEY_", "a.b `c`"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    docs, rows = hostile(spark)
    docs = docs.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *(F.concat(F.lit(f"{c}:"), F.coalesce("doc_id", F.lit(-1))).alias(c) for c in CLASH))
    base = rows[0][1].split()
    items = [*ITEMS, (4, " ".join(base[100:130]))]
    folder = str(tmp_path_factory.mktemp("hostile"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], docs.schema).write.parquet(f"{folder}/documents.parquet")
    return docs, rows, items, folder


def through(spark, given, stage):
    """Rows as (doc_id, text); all other columns must still be those of the row's id."""
    docs, _, _, folder = given
    out = STAGES[stage](spark, docs, folder)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = out.collect()
    for r in got:
        assert [r[c] for c in CLASH] == [f"{c}:{-1 if r.doc_id is None else r.doc_id}" for c in CLASH]
        assert r.n_chars == (None if r.text is None else len(r.text))
    return Counter((r.doc_id, r.text) for r in got)


def test_quality_rules(spark, given):
    docs, rows, _, _ = given
    kept = {(r.doc_id, r.n_words): r.kept for r in quality.repetition_rules(docs).collect()}
    assert through(spark, given, "quality rules") == Counter((i, t) for i, t in rows if kept[(i, len(WORD.findall(t or "")))])


def test_near_dedup(spark, given):
    _, rows, _, _ = given
    rows_ = [r for r in rows if r[0] != 14]
    classes = brute_classes(rows_)
    wanted = Counter({r for r in rows_ if r[0] is not None and classes[r[0]] == r[0]}) + Counter(r for r in rows_ if r[0] is None)
    got = through(spark, given, "MinHash near-dedup")
    assert {k: n for k, n in got.items() if k[0] != 14} == wanted
    assert {k[1] for k in got if k[0] == 14} == {"a text", "another text of its own"}


def test_substring_dedup(spark, given):
    _, rows, _, _ = given
    got = through(spark, given, "substring dedup")
    digests = sorted(((-1 if i is None else i), hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest()) for i, t in got.elements())
    assert digests == sorted((i, h) for i, _, _, h in brute_repeats(rows))
    assert got[(5, None)] == got[(6, "")] == 1


def test_decontamination(spark, given):
    _, rows, items, _ = given
    wanted = Counter(r for r in rows if not brute_contamination([r], items)[0][-1])
    assert 0 < wanted.total() < len(rows)
    assert through(spark, given, "benchmark decontamination") == wanted


def test_packing(spark, given):
    docs, rows, _, folder = given
    tokens = Counter()
    for r in STAGES["best-fit packing"](spark, docs, folder).collect():
        tokens[r.doc_id] += r.length
    wanted = Counter()
    for i, t in rows:
        wanted[i] += len(ids(t)) + 1
    assert tokens == wanted


@pytest.mark.parametrize("stage", list(STAGES))
def test_empty_tables(spark, given, stage):
    docs, _, _, folder = given
    assert STAGES[stage](spark, docs.limit(0), folder).count() == 0


def test_run_on_an_empty_table(spark, given):
    assert corpus_pipeline.run(spark, given[-1]).count() == 0
