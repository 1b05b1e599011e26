import pytest
from lodestone.operators import hierarchy, lookup, summary
from pyspark.sql import functions as F


def edges(spark, pairs, names="child string, parent string"):
    return spark.createDataFrame(pairs, names)


def test_walk_shows_shared_nodes_on_each_path(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert sorted(tuple(r.path) for r in hierarchy.walk(e, "a").collect() if r.node == "d") == [("a", "b", "d"), ("a", "c", "d")]


def test_walk_ends_on_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "a")])
    assert sorted(tuple(r.path) for r in hierarchy.walk(e, "a").collect()) == [("a",), ("a", "b")]


def test_walk_has_no_limit_of_paths(spark):
    """Three full levels of 101 nodes: over a million paths."""
    full = spark.range(3 * 101 * 101).selectExpr("concat('l', id div 10201, '-', id div 101 % 101) AS child", "concat('l', id div 10201 + 1, '-', id % 101) AS parent")
    e = full.unionByName(spark.range(101).selectExpr("'r' AS child", "concat('l0-', id) AS parent"))
    for down, edges_ in ((False, e), (True, e.select(F.col("child").alias("parent"), F.col("parent").alias("child")))):
        got = {r.depth: (r["count"], r.n) for r in hierarchy.walk(edges_, "r", 3, down).groupBy("depth").agg(F.count("*").alias("count"), F.max(F.size("path")).alias("n")).collect()}
        assert got == {d: (101**d, d + 1) for d in range(4)}


def test_reach_visits_once(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    got = {r.node: r.depth for r in hierarchy.reach(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}


def test_inherited_from_all_ancestors(spark):
    """Eight levels and a cycle at the top."""
    e = edges(spark, [(f"t{i}", f"t{i + 1}") for i in range(8)] + [("t8", "t3")])
    members = spark.createDataFrame([(f"t{i}", f"m{i}", "def") for i in range(9)] + [("t8", "m0", "def")], "owner string, name string, kind string")
    assert {r.name: r.from_owner for r in hierarchy.inherited(members, e, "t0").collect()} == {f"m{i}": f"t{i}" for i in range(1, 9)}


def test_acyclic_and_levels(spark):
    chain = edges(spark, [("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert hierarchy.is_acyclic(chain)
    assert {r.node: r.level for r in hierarchy.levels(chain).collect()} == {"a": 2, "b": 1, "c": 0}
    assert not hierarchy.is_acyclic(edges(spark, [("a", "b"), ("b", "a")], "src string, dst string"))


def test_difference(spark):
    schema = "path string, name string, sig string, line int"
    old = spark.createDataFrame([("f", "a", "x", 1), ("f", "b", "x", 2), ("f", "c", "x", 3), ("f", "o", "1", 4), ("f", "o", "2", 5)], schema)
    new = spark.createDataFrame([("f", "b", "x", 9), ("f", "c", "x", 3), ("f", "d", "x", 4), ("f", "o", "1", 4)], schema)
    got = {r.name: r.change for r in summary.difference(old, new, ["path", "name"], ["sig", "line"]).collect()}
    assert got == {"a": "removed", "b": "modified", "d": "added"}


def test_first_stage_wins(spark):
    none = spark.createDataFrame([], "x int")
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert [r.x for r in lookup.first_stage([none, a, b]).collect()] == [1]


def test_per_group(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert sorted((r.k, r.v) for r in lookup.per_group(rows, ["k"], [F.col("v")], 2).collect()) == [("a", 1), ("a", 2), ("b", 5)]


def test_long_chains(spark, monkeypatch):
    n = 1_500
    chain = edges(spark, [(i, i + 1) for i in range(n)], "src long, dst long")
    assert hierarchy.is_acyclic(chain) and not hierarchy.is_acyclic(chain.unionByName(edges(spark, [(n, 0)], "src long, dst long")))
    assert {r.node: r.level for r in hierarchy.levels(chain).collect()} == {i: n - i for i in range(n + 1)}
    with pytest.raises(ValueError):
        hierarchy.levels(edges(spark, [("a", "b"), ("b", "a")], "src string, dst string"))
    monkeypatch.setattr(hierarchy, "SMALL", 2)  # the way of large graphs
    few = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    assert hierarchy.is_acyclic(few) and {r.node: r.level for r in hierarchy.levels(few).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}
    assert not hierarchy.is_acyclic(few.unionByName(edges(spark, [("d", "b")], "src string, dst string")))


def test_expanded_implementations(spark):
    """A below B below A again: listed once more, but not opened; two of three children of each go on."""
    none = []
    rows = [("B", "class", "b", 1, "p", ["A"]), ("A", "class", "a", 1, "p", ["B"]), ("C", "class", "c", 1, "p", ["B"]), ("D", "class", "d", 1, "p", ["B"]), ("E", "def", "a0", 1, "p", ["B"])]
    s = spark.createDataFrame([(*r, none) for r in rows], "name string, kind string, path string, line int, package string, parents array<string>, type_param_parents array<string>")
    tree = lookup.expanded(s, lookup.implementations(s, "A"), "p.a", 4, 3).collect()
    assert sorted((r.depth, r.name, r.leaf) for r in tree) == [(1, "B", False), (2, "A", True), (2, "C", False)]
