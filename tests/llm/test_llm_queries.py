import re
from collections import defaultdict

import pytest
from lodestone.llm import queries

from conftest import SF


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(compare, name):
    got, wanted = compare(queries.QUERIES[name], queries.SQL[name])
    assert got == wanted


def test_near_dedup_equals_brute_force(spark):
    from test_llm_operators import brute_classes

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op4_near_dedup(spark, SF).collect()}
    assert got == brute_classes(rows)


def brute_pipeline(spark):
    """The pipeline's kept documents and their texts, by plain loops."""
    from lodestone.llm import quality
    from test_llm_operators import WORD, brute_classes, brute_contamination

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.repetition_rules(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    classes = brute_classes(rows)
    rows = sorted((i, t) for i, t in rows if classes[i] == i)
    least: dict = {}
    for i, t in rows:
        w = WORD.findall(t)
        for j in range(len(w) - 49):
            least.setdefault(tuple(w[j : j + 50]), i)
    cut = []
    for i, t in rows:
        w, gone = WORD.findall(t), set()
        for j in range(len(w) - 49):
            if least[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        cut.append((i, [x for k, x in enumerate(w) if k not in gone]))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination([(i, " ".join(w)) for i, w in cut], bench) if r[-1]}
    return {i: w for i, w in cut if i not in bad}


def test_pipeline(spark):
    import corpus_pipeline
    from test_llm_operators import WORD, ids

    wanted = brute_pipeline(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    texts = {r.doc_id: r for r in docs.collect()}
    assert {i: WORD.findall(r.text) for i, r in texts.items()} == wanted
    assert all(r.n_chars == len(r.text) for r in texts.values())
    tokens = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        tokens[r.doc_id] += r.length
    assert tokens == {i: len(ids(r.text)) + 1 for i, r in texts.items()}


def test_only_the_entry_guards_imports():
    from pathlib import Path

    root = Path(queries.__file__).parents[2]
    for f in [root / "corpus_pipeline.py", *(root / "lodestone/llm").glob("*.py")]:
        assert not re.search(r"except (ImportError|ModuleNotFoundError)", f.read_text())
    for f in (root / "lodestone").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in re.findall(r"^\s*(?:from|import) .*", f.read_text(), re.M)
