import re

import pytest
from lodestone.plans import market, registry, specimens  # noqa: F401  (both others add to the registry)

from conftest import SF


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(compare, name):
    got, wanted = compare(registry.QUERIES[name], registry.SQL[name])
    assert got == wanted


def test_package_symbols_of_all_paths(spark, tmp_path):
    """A package whose first names lie beyond path 500."""
    part = spark.read.parquet(f"{SF}/part.parquet").limit(1)
    rows = part.drop("p_partkey", "p_brand", "p_name").crossJoin(spark.range(440, 560).selectExpr("id AS p_partkey", "'Brand#13' AS p_brand", "concat('n', lpad(cast(1000 - id AS string), 3, '0')) AS p_name"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = [r.path for r in registry.QUERIES["package_symbols"](spark, str(tmp_path)).collect()]
    assert got == [f"{i:08d}" for i in range(559, 509, -1)]


def brute_tier(name, q, ends=True):
    low, want, at = name.lower(), q.lower(), 0
    if low == want:
        return 1
    if low.startswith(want):
        return 2
    if want in low:
        return 3
    if ends and len(name) >= 3 and len(name) > len(q) // 2 and want.endswith(low):
        return 4
    # Every capital of the query begins a segment of the name, in order from the first one.
    segments = re.findall("[A-Z][^A-Z]*", name)
    for s in segments:
        at += at < len(q) and s[0] == q[at]
    return 5 if at == len(q) and segments[0][0] == q[0] else None


def test_search_over_all_tiers(spark):
    s = [r.asDict() for r in registry.symbols(spark, SF).select("name", "path", "line", "package").collect()]
    wanted = {(x["name"], x["path"], x["line"], x["package"], t) for x in s if (t := brute_tier(x["name"], "CR"))}
    got = [tuple(r) for r in registry.QUERIES["search_all_tiers"](spark, SF).collect()]
    assert sorted(got) == sorted(wanted) and any(r[-1] == 5 for r in got)
    ranked = [tuple(r) for r in registry.QUERIES["search_ranked"](spark, SF).collect()]
    assert len(ranked) == min(20, len(got)) and [r[-1] for r in ranked] == sorted(r[-1] for r in got)[:20]
    files = {(f"src/{x['name']}.scala", t) for x in s if (t := brute_tier(x["name"], "CR", ends=False))}
    order = sorted(files, key=lambda f: (f[1], len(f[0]) if f[1] == 5 else 0, f[0]))
    assert [tuple(r) for r in registry.QUERIES["file_search_all"](spark, SF).collect()] == order[:30]


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    from lodestone.operators import lookup
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("path"))
    plan = lookup.kept(df, prefix="Brand#1").select("name")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_brand,Brand#1)" in plan
    assert "p_type" not in plan.split("ReadSchema")[1]
