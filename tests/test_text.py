import re

from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.functions import text as T
from pyspark.sql import functions as F


def flags(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_word_boundaries(spark):
    rows = ["Foo", "FooBar", "foo_Foo", "Foo$", "xFoo", "Foo.", "éFoo", "", "a Foo b"]
    assert flags(spark, rows, T.has_word(F.col("t"), "Foo")) == [True, False, True, True, False, True, False, False, True]
    assert flags(spark, rows, T.has_word(F.col("t"), "Foo", strict=True)) == [True, False, False, False, False, True, False, False, True]


def greedy(name, query):
    """Camel-case match by hand: on a mismatch go on to the next segment start."""
    if len(query) < 2:
        return False
    at = 0
    for c in query:
        if at < len(name) and name[at].lower() == c.lower():
            at += 1
            continue
        at += 1
        while at < len(name) and not ((name[at].isupper() or name[at - 1] == "_") and name[at].lower() == c.lower()):
            at += 1
        if at >= len(name):
            return False
        at += 1
    return True


@settings(max_examples=300, deadline=None)
@given(st.text("abABc_C", min_size=0, max_size=9), st.text("abABcC", min_size=2, max_size=4))
def test_camel_pattern_is_greedy(name, query):
    pattern = T.camel_pattern(query).replace(r"\p{Lu}", "A-Z").replace("(?=A-Z)", "(?=[A-Z])")
    assert bool(re.match(pattern, name)) == greedy(name, query)


def test_categories(spark):
    rows = ["class Foo(x: Int)", "case class Foo", "class Bar extends Foo", "import a.Foo", "// Foo here", "val x: Foo = 1", "List[Foo]", "Foo.run()", "given ord: Ordering[Foo]"]
    got = flags(spark, rows, T.category(F.col("t"), "Foo"))
    assert got == ["Definition", "Usage", "ExtendedBy", "ImportedBy", "Comment", "UsedAsType", "UsedAsType", "Usage", "UsedAsType"]


def test_tiers(spark):
    rows = ["Compiler", "CompilerRun", "TheCompiler", "piler", "xyz", "CompIler"]
    assert flags(spark, rows, T.search_tier(F.col("t"), "compiler")) == [1, 2, 3, 4, None, 1]


def test_aliases(spark):
    rows = ["import a.{B as C, D}", "import a.{X => Y, Z => _}", "import a.B as Q", "import a.B"]
    assert flags(spark, rows, T.import_aliases(F.col("t"))) == [{"B": "C"}, {"X": "Y"}, {"B": "Q"}, {}]


def test_regex_repair(spark):
    assert T.repaired(spark, "a|b") == "a|b"
    assert T.repaired(spark, "(?<=x)y") == "(?<=x)y"
    assert T.repaired(spark, "f(") == r"f\("


def test_test_paths(spark):
    rows = ["src/test/A.scala", "tests/B.scala", "src/main/A.scala", "x/FooSpec.scala", "bench-x/A.scala", "a/b.test.scala", "contest/A.scala"]
    assert flags(spark, rows, T.is_test_path(F.col("t"))) == [True, True, False, True, True, True, False]


def test_signatures(spark):
    rows = ["def f(a: Int)(b: User): List[User]", "def g: Int", "class X"]
    assert flags(spark, rows, T.returns(F.col("t"), "user")) == [True, False, False]
    assert flags(spark, rows, T.takes(F.col("t"), "USER")) == [True, False, False]
