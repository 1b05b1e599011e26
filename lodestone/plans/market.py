"""Queries of the commands over a code index made from the table of parts, each with the SQL that must give the same rows.

Every part is a symbol: six to a file, kinds by turns, parents, members, bodies, imports, tests and lines of text from other parts by arithmetic on
keys. The index is one text of SQL that Spark and DuckDB both read; queries run the real commands on it, their SQL states the wanted rows apart.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hierarchy, imports, lines, lookup, refs
from .commands import COMMON_PARENTS, Context, Flags, Result, resolve, run
from .registry import QUERIES, SQL, Query, table
from .render import to_json

TYPES = "('class', 'trait', 'object', 'enum')"


def _half(k: str, n: int) -> str:
    return f"CAST(floor({k} / {n}) AS BIGINT)"


#: Views of the index in the order of their dependence; ``{part}`` is the table of parts.
VIEWS = {
    "p": f"""SELECT p_partkey AS k, {_half("p_partkey", 6)} AS f, p_size AS line, p_type, lower(p_brand) AS brand,
      upper(substr(p_name, 1, 1)) || substr(p_name, 2, instr(p_name, ' ') - 2) || upper(substr(p_name, instr(p_name, ' ') + 1, 1)) || substr(p_name, instr(p_name, ' ') + 2)
        || CASE WHEN {_half("p_partkey", 8)} % 5 = 0 THEN '' ELSE CAST({_half("p_partkey", 8)} % 5 AS STRING) END AS name,
      CASE p_partkey % 8 WHEN 0 THEN 'class' WHEN 1 THEN 'trait' WHEN 2 THEN 'object' WHEN 3 THEN 'def' WHEN 4 THEN 'val' WHEN 5 THEN 'type' WHEN 6 THEN 'enum' ELSE 'given' END AS kind
      FROM {{part}}""",
    "q": """SELECT *, CASE WHEN f % 7 = 0 THEN 'src/test/F' WHEN f % 11 = 0 THEN 'bench-x/F' WHEN f % 13 = 0 THEN 'lib/F' ELSE 'src/main/F' END || CAST(f AS STRING)
        || CASE WHEN f % 17 = 0 THEN 'Spec.scala' ELSE '.scala' END AS path,
      CASE f % 9 WHEN 0 THEN 'java.util' WHEN 1 THEN 'scala.collection' WHEN 2 THEN 'com.acme' WHEN 3 THEN 'com.acme.core' WHEN 4 THEN 'com.acme.core.io' WHEN 5 THEN 'org.data'
        WHEN 6 THEN 'com.web' WHEN 7 THEN '' ELSE 'com.web.api' END AS package FROM p""",
    "sym": f"""SELECT a.k, a.f, a.name, a.kind, a.path, a.line, a.package, a.brand, a.p_type, b.name AS parent, c.name AS tparam,
      CASE WHEN a.kind = 'object' AND a.k % 10 = 2 THEN 'App' WHEN a.kind = 'class' AND a.k % 24 = 0 THEN 'AnyFunSuite' END AS extra,
      'def ' || lower(a.name) || '(size: ' || coalesce(b.name, 'Int') || '): ' || a.p_type AS signature
      FROM q a LEFT JOIN q b ON b.k = {_half("a.k", 2)} AND a.k > 0 AND a.kind IN {TYPES} LEFT JOIN q c ON c.k = {_half("a.k", 3)} AND a.k > 0 AND a.k % 5 = 0""",
    "mem": f"""SELECT m.k, o.name AS owner, o.kind AS owner_kind, o.line AS owner_line, CAST(m.k % 4 AS INT) AS ord, CASE WHEN m.k % 53 = 0 THEN 'main' ELSE lower(m.name) END AS name,
      CASE m.k % 4 WHEN 1 THEN 'val' WHEN 3 THEN 'type' ELSE 'def' END AS kind, o.path, CAST(m.line + 100 AS INT) AS line, CAST(m.line + 100 + m.k % 3 AS INT) AS end_line, m.signature,
      m.k % 6 = 0 AS is_override, o.package FROM sym m JOIN sym o ON o.k = {_half("m.k", 4)} AND o.k <> m.k WHERE o.kind IN {TYPES}""",
    "bod": f"""SELECT path, owner, name, kind, line AS start_line, end_line, k % 5 = 0 AS is_abstract, signature || ' = ' || owner || '.run' AS text, package FROM mem WHERE kind = 'def'
      UNION ALL SELECT path, '', name, kind, line, CAST(line + 3 AS INT), FALSE, kind || ' ' || name || ' [ ' || p_type || ' ]', package FROM sym WHERE kind IN {TYPES}""",
    "imp": f"""SELECT a.path, CAST(1 + a.k % 6 AS INT) AS line, t.package AS pkg, t.name AS target, a.k % 10 = 6 AS wild, a.k % 15 = 1 AND a.k % 10 <> 6 AS renamed,
      CASE WHEN a.k % 10 = 6 THEN 'import ' || t.package || '._' WHEN a.k % 15 = 1 THEN 'import ' || t.package || '.(' || t.name || ' => My' || t.name || ')' ELSE 'import ' || t.package || '.' || t.name END AS raw
      FROM sym a JOIN sym t ON t.k = {_half("a.k", 5)} WHERE a.k % 5 = 1 AND t.package <> ''""",
    "ln": """SELECT s.path, CAST(1 + s.k % 6 AS INT) AS line, coalesce(translate(i.raw, '()', '<>'), CASE s.k % 4 WHEN 0 THEN 'class ' || s.name || ' extends ' || coalesce(s.parent, 'Any') WHEN 1 THEN '// see ' || s.name
      WHEN 2 THEN '  val x: ' || coalesce(s.parent, s.name) ELSE '  new ' || s.name || '(1) My' || s.name END) AS text FROM sym s LEFT JOIN imp i ON i.path = s.path AND i.line = 1 + s.k % 6""",
    "tst": """SELECT path, name AS suite, line AS suite_line, CASE WHEN k % 4 <> 0 THEN 'does ' || p_type END AS test_name, CAST(line + 1 AS INT) AS line, k % 4 = 0 AS is_dynamic FROM sym WHERE f % 7 = 0""",
}
# Braces of import texts are written as other brackets in the views, as braces mark tables there.
_INDEX = ", ".join(f"{name} AS ({sql.format(part='part')})" for name, sql in VIEWS.items())
_INDEX += f", imports AS (SELECT path, line, pkg, target, wild, renamed, translate(raw, '()', '{{}}') AS import_text FROM imp)"
_INDEX += ", lns AS (SELECT path, line, CASE WHEN starts_with(text, 'import ') THEN translate(text, '<>', '{}') ELSE text END AS text FROM ln)"
_INDEX += r""", st AS (SELECT *, regexp_matches(path, '(^|/)(test|tests|testing)/|(^|/)bench-|(Test|Spec|Suite)\.(scala|java)$|\.test\.scala$') AS is_test,
  CASE WHEN package IN ('java', 'javax') OR starts_with(package, 'java.') OR starts_with(package, 'javax.') THEN 2 WHEN package = 'scala' OR starts_with(package, 'scala.') THEN 1 ELSE 0 END AS std,
  list_filter([parent, extra], lambda x: x IS NOT NULL) AS parents FROM sym),
pop AS (SELECT lower(target) AS low, count(*) AS imports FROM imports WHERE NOT wild GROUP BY 1)"""
INDEX_SQL = f"WITH RECURSIVE {_INDEX}"
#: The order of definitions, of members, and what ends all orders.
DEF_ORDER = "CASE WHEN kind IN ('class', 'trait', 'object', 'enum') THEN 0 WHEN kind IN ('type', 'given') THEN 1 ELSE 2 END, is_test, std, length(path), path, line, name"
MEMBER_ORDER = "CASE kind WHEN 'def' THEN 1 WHEN 'val' THEN 2 WHEN 'var' THEN 3 WHEN 'type' THEN 3 ELSE 4 END, ord"


class MarketTables:
    """The tables of a code index, as ``Tables`` has them, over the parts of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, views = spark, {"part": table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")}
        for name, sql in VIEWS.items():
            used = {k: v for k, v in views.items() if f" {k}" in sql or f"{{{k}}}" in sql}
            views[name] = spark.sql(_placed(sql, used), **used)
        self.views = views

    @property
    def index(self) -> DataFrame:
        return self.views["sym"]

    @property
    def symbols(self) -> DataFrame:
        s = self.views["sym"]
        return s.select(
            "name", "kind", "path", "line", "package", F.array_compact(F.array("parent", "extra")).alias("parents"), F.array_compact(F.array("tparam")).alias("type_param_parents"), "signature",
            F.array_compact(F.array("brand", F.when(F.col("k") % 9 == 0, "main"))).alias("annotations"),
        )

    @property
    def files(self) -> DataFrame:
        s = self.views["sym"].groupBy("path").agg(F.min("package").alias("package"), F.min("f").alias("f"))
        return s.select("path", F.col("f").cast("string").alias("oid"), F.lit("scala").alias("lang"), "package", T.is_test_path(F.col("path")).alias("is_test"), (F.col("f") % 19 == 0).alias("parse_failed"))

    @property
    def texts(self) -> DataFrame:
        braced = F.when(F.col("text").startswith("import "), F.translate("text", "<>", "{}")).otherwise(F.col("text"))
        rows = self.views["ln"].select("path", F.struct("line", braced.alias("text")).alias("x"))
        return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.text), "\n").alias("text"))

    @property
    def members(self) -> DataFrame:
        return self.views["mem"].drop("k").withColumn("annotations", F.array().cast("array<string>"))

    @property
    def bodies(self) -> DataFrame:
        return self.views["bod"]

    @property
    def docs(self) -> DataFrame:
        return self.views["sym"].where("k % 2 = 0").select("path", "line", F.concat(F.lit("Doc of "), "name").alias("doc"))

    @property
    def scopes(self) -> DataFrame:
        return self.views["sym"].select("path", "name", "kind", F.col("line").alias("start_line"), (F.col("line") + 10).alias("end_line"), (F.col("k") % 3).cast("int").alias("depth"))

    @property
    def tests(self) -> DataFrame:
        return self.views["tst"]

    @property
    def _raw_imports(self) -> DataFrame:
        return self.views["imp"].select("path", "line", F.translate("raw", "()", "{}").alias("import_text"), F.lit("scala").alias("lang"))

    @property
    def imports(self) -> DataFrame:
        return imports.parsed(self._raw_imports)

    @property
    def aliases(self) -> DataFrame:
        return self._raw_imports.select("path", F.explode(T.import_aliases(F.col("import_text"))).alias("original", "alias"))


def _placed(sql: str, used: dict[str, DataFrame]) -> str:
    """The same SQL with the views it reads as placeholders."""
    for name in used:
        if name != "part":
            sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return sql


def ask(spark: SparkSession, sf: str, command: str, *args: str, **flags) -> Result:
    return run(context(spark, sf, **flags), command, list(args))


def context(spark: SparkSession, sf: str, **flags) -> Context:
    return Context(MarketTables(spark, sf), Flags(**flags))


def named(spark: SparkSession, sf: str, k: int) -> str:
    """The name of the symbol number ``k``."""
    return MarketTables(spark, sf).views["sym"].where(F.col("k") == k).first()["name"]


def market(sql: str):
    """Registers a query whose SQL follows the views of the index."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"{INDEX_SQL}{sql}"
        return f

    return add


PLACE = ("name", "kind", "path", "line", "package")

# --- C1 to C11: lookup ----------------------------------------------------------------------------------------


@market(" SELECT count(DISTINCT path) AS files, count(*) AS symbols, count(DISTINCT nullif(package, '')) AS packages, (SELECT count(DISTINCT path) FROM sym WHERE f % 19 = 0) AS parse_failures FROM sym")
def cmd_index(spark, sf):
    r = ask(spark, sf, "index")
    return r.parts["totals"].join(F.broadcast(r.parts["files"].select("parse_failures")))


@market(" SELECT kind, count(*) AS \"count\" FROM sym GROUP BY kind")
def cmd_index_kinds(spark, sf):
    return ask(spark, sf, "index").parts["kinds"]


_TIER_CR = """CASE WHEN lower(name) = 'cr' THEN 1 WHEN starts_with(lower(name), 'cr') THEN 2 WHEN contains(lower(name), 'cr') THEN 3 WHEN length(name) >= 3 AND length(name) > 1 AND ends_with('cr', lower(name)) THEN 4
  WHEN regexp_matches(name, '^[cC]([rR]|.+R|.*_[rR])') THEN 5 END"""
_SEARCH = """, hit AS (SELECT DISTINCT ON (name, path, line) st.*, coalesce(imports, 0) AS imports, {tier} AS tier FROM st LEFT JOIN pop ON low = lower(name) WHERE {where})
  SELECT name, path, line, tier, imports FROM hit WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 5 THEN 0 WHEN kind IN ('class', 'trait', 'enum') THEN 0 WHEN kind = 'object' THEN 1 WHEN kind IN ('def', 'val', 'type') THEN 2 ELSE 3 END,
  CASE WHEN tier < 5 THEN is_test END, CASE WHEN tier < 5 THEN std END, CASE WHEN tier < 5 THEN -imports END, CASE WHEN tier < 5 THEN length(path) END, CASE WHEN tier = 5 THEN length(name) END, path, line, name LIMIT {limit}"""
_TIER_OLD = """CASE WHEN lower(name) = 'coldrod' THEN 1 WHEN starts_with(lower(name), 'coldrod') THEN 2 WHEN contains(lower(name), 'coldrod') THEN 3
  WHEN length(name) >= 3 AND length(name) > 3 AND ends_with('coldrod', lower(name)) THEN 4 WHEN regexp_matches(name, '^[cC][oO][lL][dD]([rR]|.+R)[oO][dD]') THEN 5 END"""


def _found(r: Result, n: int) -> DataFrame:
    return lookup.limited(r.parts["symbols"], n).select("name", "path", "line", "tier", "imports")


@market(_SEARCH.format(tier=_TIER_CR, where="TRUE", limit=40))
def cmd_search(spark, sf):
    """Camel case, with every key of the ranking: kind, test, library, imports, path and name length."""
    return _found(ask(spark, sf, "search", "CR"), 40)


@market(_SEARCH.format(tier=_TIER_OLD, where="TRUE", limit=25))
def cmd_search_name(spark, sf):
    return _found(ask(spark, sf, "search", "ColdRod"), 25)


@market(_SEARCH.format(tier="CASE WHEN lower(name) = 'oldrod' THEN 1 WHEN starts_with(lower(name), 'oldrod') THEN 2 END", where="TRUE", limit=25))
def cmd_search_prefix(spark, sf):
    return _found(ask(spark, sf, "search", "OldRod", prefix=True), 25)


@market(_SEARCH.format(tier="CASE WHEN lower(name) = 'hotbolt1' THEN 1 END", where="TRUE", limit=25))
def cmd_search_exact(spark, sf):
    return _found(ask(spark, sf, "search", "hotBolt1", exact=True), 25)


@market(_SEARCH.format(tier="CASE WHEN contains(lower(name), 'red') THEN CASE WHEN starts_with(lower(name), 'red') THEN 2 ELSE 3 END END", where=f"kind IN {TYPES} AND contains(lower(p_type), 'm') AND contains(lower(coalesce(parent, 'Int')), 'o')", limit=25))
def cmd_search_typed(spark, sf):
    """Types alone, by what their signature returns and takes."""
    return _found(ask(spark, sf, "search", "Red", definitions_only=True, returns="M", takes="O"), 25)


@market(" SELECT name, kind, path, line, package FROM st WHERE kind = 'class' AND NOT is_test AND starts_with(path, 'src/') AND NOT starts_with(path, 'src/main/F1') AND (package = 'com.acme' OR starts_with(package, 'com.acme.'))")
def filters(spark, sf):
    """Kind, tests, path, excluded path and package at once."""
    c = context(spark, sf, kind="Class", no_tests=True, path="/src/", exclude_path="src/main/F1", in_package="com.acme")
    return c.kept(c.tables.symbols).select(*PLACE)


@market(f" SELECT name, kind, path, line, package FROM st WHERE lower(name) = (SELECT lower(name) FROM sym WHERE k = 16) ORDER BY {DEF_ORDER} LIMIT 7")
def cmd_def(spark, sf):
    return lookup.limited(ask(spark, sf, "def", named(spark, sf, 16).upper()).parts["symbols"], 7).select(*PLACE)


@market(f", want AS (SELECT name FROM sym WHERE k = 16) SELECT name, kind, path, line, package FROM st WHERE lower(name) = (SELECT lower(name) FROM want) AND ends_with(package, 'core') ORDER BY {DEF_ORDER} LIMIT 7")
def cmd_def_partly_qualified(spark, sf):
    """No package is called ``core`` alone, so packages that end with it count."""
    found = resolve(context(spark, sf), f"core.{named(spark, sf, 16)}").orderBy(*lookup.definition_order())
    return lookup.limited(found, 7).select(*PLACE)


_OWNED = """, own AS (SELECT name FROM sym WHERE k = 24), files AS (SELECT DISTINCT path FROM st WHERE lower(name) = (SELECT lower(name) FROM own) AND kind IN ('class', 'trait', 'object', 'enum'))"""


@market(f"{_OWNED}, want AS (SELECT min(name) AS name FROM st WHERE path IN (SELECT path FROM files) AND kind = 'given') SELECT name, kind, path, line, package FROM st JOIN files USING (path) WHERE name = (SELECT name FROM want)")
def def_of_owner(spark, sf):
    """``Owner.name``: neither a package nor the end of one is called so, so the files of that type count."""
    t, owner = MarketTables(spark, sf), named(spark, sf, 24)
    files = t.symbols.where(F.lower("name") == owner.lower()).where(F.lower("kind").isin(*lookup.TYPE_KINDS)).select("path").distinct()
    last = t.symbols.join(files, "path", "left_semi").where("kind = 'given'").agg(F.min("name")).first()[0] or "none"
    return lookup.by_name(t.symbols, f"{owner}.{last}").select(*PLACE)


@market(f", own AS (SELECT name FROM sym WHERE k = 16), files AS (SELECT DISTINCT path, name FROM st WHERE name = (SELECT name FROM own) AND kind IN {TYPES}) SELECT m.name, m.kind, m.path, m.line, m.package FROM mem m JOIN files f ON f.path = m.path AND f.name = m.owner WHERE m.name = (SELECT min(name) FROM mem WHERE owner = (SELECT name FROM own))")
def member_of_owner(spark, sf):
    """``Owner.member`` where no symbol answers: members of the type."""
    c, owner = context(spark, sf), named(spark, sf, 16)
    last = c.tables.members.where(F.col("owner") == owner).agg(F.min("name")).first()[0]
    from .commands import dotted_member

    return dotted_member(c, f"{owner}.{last}").select(*PLACE)


@market(" SELECT DISTINCT ON (name, path, line) name, kind, path, line, package FROM st WHERE list_contains(list_transform(parents, lambda x: lower(x)), (SELECT lower(name) FROM sym WHERE k = 12)) OR lower(tparam) = (SELECT lower(name) FROM sym WHERE k = 12)")
def cmd_impl(spark, sf):
    """Direct parents and type arguments of parents."""
    return ask(spark, sf, "impl", named(spark, sf, 12)).parts["symbols"].select("name", "kind", "path", "line", "package")


@market(" SELECT name, kind, path, line, package FROM st WHERE path = (SELECT path FROM sym WHERE k = 31)")
def cmd_symbols(spark, sf):
    path = MarketTables(spark, sf).views["sym"].where("k = 31").first()["path"]
    return ask(spark, sf, "symbols", path).parts["symbols"].select(*PLACE)


@market(" SELECT kind, count(*) AS \"count\" FROM st WHERE path = (SELECT path FROM sym WHERE k = 31) GROUP BY kind")
def cmd_symbols_summary(spark, sf):
    path = MarketTables(spark, sf).views["sym"].where("k = 31").first()["path"]
    return ask(spark, sf, "symbols", path, summary=True).parts["counts"]


_BASE = r"regexp_replace(regexp_replace(path, '^.*/', ''), '\.[^.]*$', '')"


@market(f", f0 AS (SELECT DISTINCT path, lower({_BASE}) AS low, {_BASE} AS base FROM sym), f1 AS (SELECT path, CASE WHEN low = 'f1' THEN 1 WHEN starts_with(low, 'f1') THEN 2 WHEN contains(low, 'f1') THEN 3 END AS tier FROM f0) SELECT path AS value, tier FROM f1 WHERE tier IS NOT NULL ORDER BY tier, path LIMIT 30")
def cmd_file(spark, sf):
    return lookup.limited(ask(spark, sf, "file", "F1").parts["strings"], 30)


@market(f", f0 AS (SELECT DISTINCT path, {_BASE} AS base FROM sym) SELECT path AS value, 5 AS tier FROM f0 WHERE regexp_matches(base, '^[fF]([sS]|.+S)') AND NOT contains(lower(base), 'fs') ORDER BY length(path), path LIMIT 30")
def cmd_file_camel(spark, sf):
    """File names by camel case, the shortest paths first."""
    return lookup.limited(ask(spark, sf, "file", "FS").parts["strings"], 30)


@market(" SELECT DISTINCT package AS value FROM sym WHERE package <> ''")
def cmd_packages(spark, sf):
    return ask(spark, sf, "packages").parts["strings"]


_PACKAGE_ORDER = "CASE kind WHEN 'trait' THEN 0 WHEN 'class' THEN 1 WHEN 'enum' THEN 2 WHEN 'object' THEN 3 ELSE 4 END, name, path, line"


@market(f" SELECT name, kind, path, line FROM st WHERE package = 'com.acme.core' ORDER BY {_PACKAGE_ORDER} LIMIT 33")
def cmd_package(spark, sf):
    """``core`` ends one package's name and is contained in another."""
    return lookup.limited(ask(spark, sf, "package", "core").parts["symbols"], 33).select("name", "kind", "path", "line")


@market(
    f""", edges AS (SELECT name, path, line, unnest(list_distinct(list_transform(list_concat(parents, list_filter([tparam], lambda x: x IS NOT NULL)), lambda x: lower(x)))) AS up FROM st),
    many AS (SELECT up, count(DISTINCT (name, path, line)) AS impl_count FROM edges GROUP BY up)
    SELECT name, kind, path, line, coalesce(impl_count, 0) AS impl_count FROM st LEFT JOIN many ON up = lower(name) WHERE package = 'com.web' AND kind IN {TYPES}"""
)
def cmd_package_explained(spark, sf):
    """How many symbols each type of a package has below it."""
    return ask(spark, sf, "package", "com.web", explain=True).parts["symbols"].select("name", "kind", "path", "line", "impl_count")


@market(" SELECT name, kind, path, line, package FROM st WHERE brand = 'brand#7' AND kind = 'def'")
def cmd_annotated(spark, sf):
    return ask(spark, sf, "annotated", "@Brand#7", kind="def").parts["symbols"].select(*PLACE)


_NEAR = """, hit AS (SELECT DISTINCT ON (name, path, line) st.*, CASE WHEN starts_with(lower(name), 'coldro') THEN 2 ELSE 3 END AS tier FROM st WHERE contains(lower(name), 'coldro'))
  SELECT name, kind, path, line, package FROM hit ORDER BY tier, CASE WHEN kind IN ('class', 'trait', 'enum') THEN 0 WHEN kind = 'object' THEN 1 WHEN kind IN ('def', 'val', 'type') THEN 2 ELSE 3 END, is_test, std, length(path), path, line, name LIMIT 5"""


@market(_NEAR)
def suggestions(spark, sf):
    """What a lookup without a result proposes."""
    return ask(spark, sf, "def", "ColdRo").parts["suggestions"]


# --- C5, C6, C12, C18: references, imports, lines ----------------------------------------------------------------

_W = r"(^|[^\p{{L}}\p{{Nd}}]){0}($|[^\p{{L}}\p{{Nd}}])"
_NAME16 = "(SELECT name FROM sym WHERE k = 16)"
_HITS = rf""", w AS (SELECT {_NAME16} AS n), al AS (SELECT path, max('My' || target) AS alias FROM imports, w WHERE renamed AND target = n GROUP BY path),
own AS (SELECT path, line, trim(text, ' ') AS context, NULL AS alias, n FROM lns, w WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}])' || n || '($|[^\p{{L}}\p{{Nd}}])')),
via AS (SELECT path, line, trim(text, ' ') AS context, alias, n FROM lns JOIN al USING (path), w WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}])' || alias || '($|[^\p{{L}}\p{{Nd}}])') AND (path, line) NOT IN (SELECT path, line FROM own)),
hits AS (SELECT *, CASE WHEN regexp_matches(context, '^(trait|class|object|enum|given|type|def|val|var)\s') AND regexp_matches(context, '(^|[^\p{{L}}\p{{Nd}}])' || n || '($|[^\p{{L}}\p{{Nd}}])') AND regexp_matches(context, '(trait|class|object|enum|type) ' || n) THEN 'Definition'
  WHEN regexp_matches(context, '\b(extends|with)\b') AND alias IS NULL THEN 'ExtendedBy' WHEN starts_with(context, 'import ') THEN 'ImportedBy' WHEN starts_with(context, '//') THEN 'Comment'
  WHEN regexp_matches(context, ':\s*' || n || '|\[' || n) THEN 'UsedAsType' ELSE 'Usage' END AS category FROM (SELECT * FROM own UNION ALL SELECT * FROM via)),
fp AS (SELECT path, min(package) AS package FROM sym GROUP BY path), tp AS (SELECT DISTINCT package FROM sym, w WHERE lower(name) = lower(n)),
lv AS (SELECT h.*, CASE WHEN alias IS NOT NULL OR package IN (SELECT package FROM tp) OR path IN (SELECT path FROM imports, w WHERE contains(import_text, '.' || n) OR contains(import_text, n || ',') OR contains(import_text, ', ' || n) OR contains(import_text, '{{' || n || '}}')) THEN 'High'
  WHEN path IN (SELECT path FROM imports WHERE wild AND pkg IN (SELECT package FROM tp)) THEN 'Medium' ELSE 'Low' END AS confidence FROM hits h JOIN fp USING (path))"""
_HITS = _HITS.replace("{{", "{").replace("}}", "}")
_CONF = "CASE confidence WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"


@market(f"{_HITS} SELECT path, line, context, alias, category, confidence FROM lv ORDER BY {_CONF}, path, line LIMIT 60")
def cmd_refs(spark, sf):
    """References with aliases, categories and confidence, in the flat order."""
    found = ask(spark, sf, "refs", named(spark, sf, 16), flat=True).parts["references"]
    return lookup.limited(found, 60).select("path", "line", "context", "alias", "category", "confidence")


@market(f"{_HITS} SELECT path, line, category, confidence FROM lv QUALIFY row_number() OVER (PARTITION BY confidence, category ORDER BY path, line) <= 3")
def cmd_refs_grouped(spark, sf):
    """The first of each category and confidence."""
    return ask(spark, sf, "refs", named(spark, sf, 16), limit=3).parts["references"].select("path", "line", "category", "confidence")


@market(f"{_HITS} SELECT category, count(*) AS \"count\" FROM hits GROUP BY category")
def cmd_refs_count(spark, sf):
    return ask(spark, sf, "refs", named(spark, sf, 16), count=True).parts["counts"]


@market(f"{_HITS} SELECT path, count(*) AS \"count\" FROM hits WHERE category = 'Usage' GROUP BY path ORDER BY 2 DESC, path LIMIT 4")
def cmd_refs_category(spark, sf):
    """The files with most references of one category."""
    return ask(spark, sf, "refs", named(spark, sf, 16), category="usage", top=4).parts["counts"]


@market(f"{_HITS} SELECT path, line, category FROM hits JOIN fp USING (path) WHERE (package = 'com.acme' OR starts_with(package, 'com.acme.')) AND NOT starts_with(path, 'src/test/')")
def refs_in_package(spark, sf):
    """References in one package and outside one folder."""
    found = ask(spark, sf, "refs", named(spark, sf, 16), flat=True, in_package="com.acme", exclude_path="src/test/").parts["references"]
    return found.select("path", "line", "category")


_IMPORTERS = r""", w AS (SELECT name AS n FROM sym WHERE k = 3), tp AS (SELECT DISTINCT package FROM sym, w WHERE lower(name) = lower(n)),
bring AS (SELECT path, line, text AS context FROM lns, w WHERE starts_with(text, 'import ') AND regexp_matches(text, '(^|[^\p{L}\p{Nd}])' || n || '($|[^\p{L}\p{Nd}])')
  UNION SELECT path, line, import_text FROM imports WHERE wild AND pkg IN (SELECT package FROM tp))"""


@market(f"{_IMPORTERS} SELECT path, line, context FROM bring")
def cmd_imports(spark, sf):
    """Import lines that bring a name in, by name or by a wildcard of one of its packages."""
    return ask(spark, sf, "imports", named(spark, sf, 3)).parts["references"].select("path", "line", "context")


@market(rf", w AS (SELECT {_NAME16} AS n), al AS (SELECT path, max('My' || target) AS alias FROM imports, w WHERE renamed AND target = n GROUP BY path), hit AS (SELECT path, line FROM lns LEFT JOIN al USING (path), w WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}])' || n || '($|[^\p{{L}}\p{{Nd}}])') OR (alias IS NOT NULL AND regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}])' || alias || '($|[^\p{{L}}\p{{Nd}}])'))) SELECT count(*) AS reference_count, count(DISTINCT path) AS test_file_count FROM hit JOIN (SELECT DISTINCT path, is_test FROM st) USING (path) WHERE is_test")
def cmd_coverage(spark, sf):
    return ask(spark, sf, "coverage", named(spark, sf, 16)).parts["totals"]


@market(r" SELECT path, line, trim(text, ' ') AS context FROM lns WHERE regexp_matches(text, 'class \w*Rod|^import [a-z.]+\._')")
def cmd_grep(spark, sf):
    return ask(spark, sf, "grep", r"class \w*Rod", patterns=(r"^import [a-z.]+\._",)).parts["references"]


@market(" SELECT count(*) AS matches, count(DISTINCT path) AS files FROM lns JOIN (SELECT DISTINCT path, is_test FROM st) USING (path) WHERE contains(text, 'extends') AND NOT is_test")
def cmd_grep_count(spark, sf):
    return ask(spark, sf, "grep", "extends", count=True, no_tests=True).parts["totals"]


@market(", spans AS (SELECT DISTINCT path, start_line, end_line FROM bod WHERE name = (SELECT name FROM sym WHERE k = 1)) SELECT DISTINCT path, l.line, trim(text, ' ') AS context FROM lns l JOIN spans USING (path) WHERE l.line BETWEEN start_line AND end_line AND contains(text, 'e')")
def cmd_grep_in(spark, sf):
    """Lines inside the bodies of a name."""
    return ask(spark, sf, "grep", "e", inside=named(spark, sf, 1)).parts["references"]


class _LowLines(MarketTables):
    """Members at the first lines of their files, so that lines fall into them."""

    @property
    def members(self) -> DataFrame:
        return super().members.withColumns({"line": F.col("ord") + 1, "end_line": F.col("ord") + 3})


@market(" SELECT m.path, m.name AS method, m.ord + 1 AS start_line, count(*) AS matches FROM lns l JOIN mem m ON m.path = l.path AND l.line BETWEEN m.ord + 1 AND m.ord + 3 WHERE lower(m.owner) = (SELECT lower(name) FROM sym WHERE k = 16) AND contains(text, 'e') GROUP BY m.path, m.name, m.signature, m.ord")
def cmd_grep_methods(spark, sf):
    """Matches by method of a type."""
    c = Context(_LowLines(spark, sf), Flags(inside=named(spark, sf, 16), each_method=True))
    return run(c, "grep", ["e"]).parts["methods"].select("path", "method", "start_line", "matches")


# --- C13, C14, C16, C17, C23: members, bodies, docs, tests, scopes ------------------------------------------------------


_TARGET = f", w AS (SELECT name AS n FROM sym WHERE k = 16), ty AS (SELECT DISTINCT path, name, kind FROM sym, w WHERE lower(name) = lower(n) AND kind IN {TYPES})"


@market(f"{_TARGET} SELECT m.owner, m.name, m.kind, m.path, m.line, m.is_override FROM mem m JOIN ty t ON t.path = m.path AND t.name = m.owner AND t.kind = m.owner_kind")
def cmd_members(spark, sf):
    return ask(spark, sf, "members", named(spark, sf, 16)).parts["members"].select("owner", "name", "kind", "path", "line", "is_override")


_ABOVE = f""", firsts AS (SELECT DISTINCT ON (lower(name)) lower(name) AS node, st.* FROM st WHERE kind IN {TYPES} ORDER BY lower(name), {DEF_ORDER}),
tg AS (SELECT DISTINCT node AS child, lower(unnest(parents)) AS parent FROM firsts, w WHERE node <> lower(n) UNION SELECT lower(n), lower(unnest(parents)) FROM st, w WHERE lower(name) = lower(n) AND kind IN {TYPES}),
up(node) AS (SELECT lower(n) FROM w UNION SELECT parent FROM up JOIN tg ON child = node)"""


@market(
    f"""{_TARGET}{_ABOVE}, own AS (SELECT DISTINCT m.* FROM mem m JOIN ty t ON t.path = m.path AND t.name = m.owner AND t.kind = m.owner_kind),
    far AS (SELECT DISTINCT path, name, kind FROM firsts WHERE node IN (SELECT node FROM up WHERE node <> (SELECT lower(n) FROM w))),
    theirs AS (SELECT m.* FROM mem m JOIN far f ON f.path = m.path AND f.name = m.owner AND f.kind = m.owner_kind)
    SELECT owner, name, kind, path, line, is_override OR (name, kind) IN (SELECT name, kind FROM theirs) AS is_override, FALSE AS inherited FROM own
    UNION ALL SELECT owner, name, kind, path, line, is_override, TRUE FROM theirs WHERE (name, kind) NOT IN (SELECT name, kind FROM own)"""
)
def cmd_members_inherited(spark, sf):
    """Members of all ancestors, however far up, and marks of those that the type itself redefines."""
    return ask(spark, sf, "members", named(spark, sf, 16), inherited=True).parts["members"].select("owner", "name", "kind", "path", "line", "is_override", "inherited")


@market(f", w AS (SELECT name AS n FROM sym WHERE k = 16), d AS (SELECT path, line, 'Doc of ' || name AS doc FROM sym WHERE k % 2 = 0) SELECT s.name, s.kind, s.path, s.line, s.package, doc FROM sym s JOIN w ON lower(name) = lower(n) LEFT JOIN d ON d.path = s.path AND d.line = s.line")
def cmd_doc(spark, sf):
    return ask(spark, sf, "doc", named(spark, sf, 16)).parts["docs"]


_FILES = f"files AS (SELECT DISTINCT path FROM sym WHERE lower(name) = (SELECT lower(name) FROM m) UNION SELECT DISTINCT path FROM sym WHERE kind IN {TYPES} AND (SELECT lower(name) FROM m) NOT IN (SELECT lower(name) FROM sym))"


@market(f", m AS (SELECT name FROM sym WHERE k = 16), {_FILES} SELECT path, owner, name, start_line, end_line, text FROM bod JOIN files USING (path) WHERE name = (SELECT name FROM m)")
def cmd_body(spark, sf):
    """A body is looked for in the files that define its name."""
    return ask(spark, sf, "body", named(spark, sf, 16)).parts["bodies"].select("path", "owner", "name", "start_line", "end_line", "text")


@market(f", m AS (SELECT 'main' AS name), {_FILES} SELECT path, owner, name, start_line, end_line, text FROM bod JOIN files USING (path) WHERE name = (SELECT name FROM m)")
def cmd_body_local(spark, sf):
    """No file defines the name, so all files with types are searched."""
    return ask(spark, sf, "body", "main").parts["bodies"].select("path", "owner", "name", "start_line", "end_line", "text")


@market(", m AS (SELECT owner, name FROM mem WHERE kind = 'def' ORDER BY name, owner LIMIT 1) SELECT path, owner, name, start_line FROM bod WHERE name = (SELECT name FROM m) AND owner = (SELECT owner FROM m)")
def cmd_body_of_owner(spark, sf):
    """``Owner.name``: bodies in that owner alone."""
    m = MarketTables(spark, sf).members.where("kind = 'def'").orderBy("name", "owner").first()
    return ask(spark, sf, "body", f"{m['owner']}.{m['name']}").parts["bodies"].select("path", "owner", "name", "start_line")


@market(" SELECT path, suite, test_name, line FROM tst WHERE test_name IS NOT NULL AND (contains(lower(test_name), 'promo') OR contains(lower(suite), 'promo'))")
def cmd_tests(spark, sf):
    return ask(spark, sf, "tests", "PROMO").parts["tests"].select("path", "suite", "test_name", "line")


@market(" SELECT count(DISTINCT (path, suite, suite_line)) AS suites, count(*) FILTER (NOT is_dynamic) AS tests, count(*) FILTER (is_dynamic) AS dynamic_sites FROM tst WHERE starts_with(path, 'src/test/F1')")
def cmd_tests_count(spark, sf):
    return ask(spark, sf, "tests", count=True, path="src/test/F1").parts["totals"]


@market(" SELECT name, kind, line FROM sym WHERE path = (SELECT path FROM sym WHERE k = 40) AND 20 BETWEEN line AND line + 10")
def cmd_context(spark, sf):
    path = MarketTables(spark, sf).views["sym"].where("k = 40").first()["path"]
    return ask(spark, sf, "context", f"{path}:20").parts["scopes"]


# --- C19 to C22, C25: hierarchies and explanations ---------------------------------------------------------------------

_WALK = f""", w AS (SELECT lower(name) AS n FROM sym WHERE k = 16), tg AS (SELECT DISTINCT lower(name) AS child, lower(unnest(parents)) AS parent FROM st WHERE kind IN {TYPES}),
first AS (SELECT DISTINCT ON (lower(name)) lower(name) AS low, path AS file FROM st WHERE kind IN {TYPES} ORDER BY lower(name), {DEF_ORDER})"""


@market(
    f"""{_WALK}, walk(depth, node, path) AS (SELECT 0, n, [n] FROM w UNION ALL SELECT depth + 1, parent, list_append(path, parent) FROM walk JOIN tg ON child = node WHERE depth < 3 AND NOT list_contains(path, parent))
    SELECT depth, node, array_to_string(path, '>') AS path, file, file IS NULL AS is_external FROM walk LEFT JOIN first ON low = node"""
)
def cmd_hierarchy_up(spark, sf):
    r = ask(spark, sf, "hierarchy", named(spark, sf, 16), up=True, depth=3).parts["parents"]
    return r.select("depth", "node", F.array_join("path", ">").alias("path"), "file", "is_external")


@market(
    f"""{_WALK}, walk(depth, node, path) AS (SELECT 0, n, [n] FROM w UNION ALL SELECT depth + 1, child, list_append(path, child) FROM walk JOIN tg ON parent = node WHERE depth < 2 AND NOT list_contains(path, child))
    SELECT depth, node, array_to_string(path, '>') AS path, file FROM walk LEFT JOIN first ON low = node"""
)
def cmd_hierarchy_down(spark, sf):
    r = ask(spark, sf, "hierarchy", named(spark, sf, 16), down=True, depth=2).parts["children"]
    return r.select("depth", "node", F.array_join("path", ">").alias("path"), "file")


@market(f", own AS (SELECT DISTINCT path, name FROM st WHERE len(parents) > 0) SELECT m.owner, m.name, m.path, m.line FROM mem m JOIN own o ON o.path = m.path AND o.name = m.owner WHERE m.name = (SELECT min(name) FROM mem)")
def cmd_overrides(spark, sf):
    name = MarketTables(spark, sf).members.agg(F.min("name")).first()[0]
    return ask(spark, sf, "overrides", name).parts["overrides"].select("owner", "name", "path", "line")


@market(", u AS (SELECT lower(name) AS n FROM sym WHERE k = 6), own AS (SELECT DISTINCT path, name FROM st, u WHERE list_contains(list_transform(parents, lambda x: lower(x)), n) OR lower(tparam) = n), one AS (SELECT min(m.name) AS name FROM mem m JOIN own o ON o.path = m.path AND o.name = m.owner) SELECT m.owner, m.name, m.path, m.line FROM mem m JOIN own o ON o.path = m.path AND o.name = m.owner WHERE m.name = (SELECT name FROM one)")
def cmd_overrides_of(spark, sf):
    """Members of one name in what lies below a type."""
    t, top = MarketTables(spark, sf), named(spark, sf, 6)
    below = lookup.implementations(t.symbols, top).select("path", F.col("name").alias("owner")).distinct()
    name = t.members.join(below, ["path", "owner"], "left_semi").agg(F.min("name")).first()[0] or "none"
    return ask(spark, sf, "overrides", name, of=top).parts["overrides"].select("owner", "name", "path", "line")


@market(f", m AS (SELECT DISTINCT path, owner AS name FROM mem WHERE name = 'main') SELECT name, kind, path, line, package FROM st WHERE kind IN {TYPES} AND (path, name) IN (SELECT path, name FROM m)")
def cmd_ast_method(spark, sf):
    return ask(spark, sf, "ast-pattern", has_method="main").parts["symbols"].select(*PLACE)


@market(f", u AS (SELECT lower(name) AS n FROM sym WHERE k = 6) SELECT name, kind, path, line, package FROM st, u WHERE kind IN {TYPES} AND list_contains(list_transform(parents, lambda x: lower(x)), n) AND NOT is_test")
def cmd_ast_extends(spark, sf):
    return ask(spark, sf, "ast-pattern", extends=named(spark, sf, 6), no_tests=True).parts["symbols"].select(*PLACE)


@market(f", b AS (SELECT DISTINCT path, name, start_line AS line FROM bod WHERE contains(text, '[ PROMO')) SELECT name, kind, path, line, package FROM st WHERE kind IN {TYPES} AND (path, name, line) IN (SELECT path, name, line FROM b) AND list_contains(list_transform(parents, lambda x: lower(x)), 'app')")
def cmd_ast_body(spark, sf):
    """Types that extend App and whose body holds a text."""
    return ask(spark, sf, "ast-pattern", extends="App", body_contains="[ PROMO").parts["symbols"].select(*PLACE)


_DEPS = f""", w AS (SELECT lower(name) AS n FROM sym WHERE k = 16), known AS (SELECT DISTINCT lower(name) AS low FROM sym),
e AS (SELECT DISTINCT lower(s.name) AS src, lower(i.target) AS dst, 'import' AS source FROM imports i JOIN sym s USING (path) WHERE NOT wild
  UNION SELECT DISTINCT lower(name), lower(unnest(regexp_extract_all(text, '[\\p{{L}}_][\\p{{L}}\\p{{Nd}}_]+'))), 'body' FROM bod WHERE lower(name) IN (SELECT low FROM known)),
edges AS (SELECT src, dst, max(source) AS source FROM e WHERE src <> dst AND dst IN (SELECT low FROM known) GROUP BY src, dst),
one AS (SELECT DISTINCT dst AS node FROM edges, w WHERE src = n AND dst <> n), two AS (SELECT DISTINCT dst AS node FROM edges JOIN one ON src = node WHERE dst <> (SELECT n FROM w) AND dst NOT IN (SELECT node FROM one)),
first AS (SELECT DISTINCT ON (lower(name)) lower(name) AS low, st.* FROM st ORDER BY lower(name), {DEF_ORDER})"""


@market(f"{_DEPS} SELECT name, path, depth, source FROM (SELECT node, 1 AS depth FROM one UNION ALL SELECT node, 2 FROM two) d JOIN first ON low = node LEFT JOIN (SELECT dst, source FROM edges, w WHERE src = n) x ON dst = node")
def cmd_deps(spark, sf):
    """Dependencies by imports and by names in bodies, two deep."""
    return ask(spark, sf, "deps", named(spark, sf, 16), depth=2).parts["deps"].select("name", "path", "depth", "source")


_FIRST16 = f", w AS (SELECT name AS n FROM sym WHERE k = 16), root AS (SELECT st.* FROM st, w WHERE lower(name) = lower(n) ORDER BY {DEF_ORDER} LIMIT 1)"


@market(f"{_FIRST16} SELECT m.name, m.kind, m.line FROM mem m JOIN root r ON r.path = m.path AND r.name = m.owner AND r.kind = m.owner_kind ORDER BY {MEMBER_ORDER.replace('kind', 'm.kind').replace('ord', 'm.ord')} LIMIT 2")
def cmd_explain_members(spark, sf):
    """The first members of the best definition, in the order of members."""
    return ask(spark, sf, "explain", named(spark, sf, 16), members_limit=2).parts["members"].select("name", "kind", "line")


@market(f"{_FIRST16} SELECT DISTINCT ON (name, path, line) name, path, line FROM st, w WHERE list_contains(list_transform(parents, lambda x: lower(x)), lower(n)) OR lower(tparam) = lower(n) ORDER BY path, line, name LIMIT 4")
def cmd_explain_implementations(spark, sf):
    return ask(spark, sf, "explain", named(spark, sf, 16), impl_limit=4).parts["implementations"].select("name", "path", "line")


@market(
    f"""{_FIRST16}, said AS (SELECT unnest(regexp_extract_all(m.signature, '\\b[A-Z][A-Za-z0-9]+\\b')) AS x FROM mem m JOIN root r ON r.path = m.path AND r.name = m.owner AND r.kind = m.owner_kind UNION SELECT unnest(parents) FROM root),
    low AS (SELECT DISTINCT lower(x) AS x FROM said WHERE lower(x) NOT IN ('int', 'string', (SELECT lower(name) FROM root))),
    own AS (SELECT lower(name) AS x FROM sym GROUP BY 1 HAVING NOT bool_and(regexp_matches(lower(package), '^(java|javax|scala)([.]|$)'))),
    first AS (SELECT DISTINCT ON (lower(name)) lower(name) AS x, st.* FROM st WHERE kind IN {TYPES} ORDER BY lower(name), {DEF_ORDER})
    SELECT name, kind, path, line, package FROM first WHERE x IN (SELECT x FROM low) AND x IN (SELECT x FROM own) ORDER BY name, path, line LIMIT 10"""
)
def cmd_explain_related(spark, sf):
    """Types of the index that the members' signatures and the parents name."""
    return ask(spark, sf, "explain", named(spark, sf, 16), related=True).parts["related"]


@market(
    f"""{_FIRST16}, rk AS (SELECT lower(package || '.' || name) AS key FROM root),
    all1 AS (SELECT DISTINCT ON (name, path, line) st.* FROM st, w WHERE list_contains(list_transform(parents, lambda x: lower(x)), lower(n)) OR lower(tparam) = lower(n)),
    l1 AS (SELECT name, kind, path, line, lower(package || '.' || name) AS key FROM (SELECT * FROM all1 ORDER BY path, line, name LIMIT 2) WHERE kind IN {TYPES}),
    c2 AS (SELECT DISTINCT a.name AS up, a.path AS up_path, a.line AS up_line, s.name, s.kind, s.path, s.line FROM l1 a JOIN st s ON list_contains(list_transform(s.parents, lambda x: lower(x)), lower(a.name)) OR lower(s.tparam) = lower(a.name)
      WHERE a.key NOT IN (SELECT key FROM rk)),
    l2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY up, up_path, up_line ORDER BY path, line, name) <= 2)
    SELECT name, path, line, 1 AS depth FROM l1 UNION SELECT name, path, line, 2 FROM l2 WHERE kind IN {TYPES}"""
)
def cmd_explain_expanded(spark, sf):
    """Implementations level by level, the first two of each."""
    return ask(spark, sf, "explain", named(spark, sf, 16), expand=2, impl_limit=2).parts["expanded"].select("name", "path", "line", "depth").distinct()


def _json(spark, answer: str) -> DataFrame:
    """One row for each object of a JSON list."""
    return spark.createDataFrame([(json.dumps(x, ensure_ascii=False, separators=(",", ":")),) for x in json.loads(answer)], "json string")


@market(f""" SELECT '{{"name":"' || name || '","kind":"' || kind || '","file":"' || path || '","line":' || line || ',"package":"' || package || '"}}' AS json FROM st WHERE lower(name) = (SELECT lower(name) FROM sym WHERE k = 16) ORDER BY {DEF_ORDER} LIMIT 6""")
def json_symbols(spark, sf):
    """What the command line prints as JSON."""
    c = context(spark, sf, json=True, limit=6)
    return _json(spark, to_json(run(c, "def", [named(spark, sf, 16)]), c)).select(F.regexp_replace("json", r',"(signature|parents|annotations)":.*', "}").alias("json"))


# --- C10, C15, C26 to C28: packages and summaries -----------------------------------------------------------------------


@market(
    """, one AS (SELECT name, min(path) AS path FROM sym WHERE package = 'com.acme' GROUP BY name), fp AS (SELECT path, min(package) AS package FROM sym GROUP BY path),
    far AS (SELECT i.* FROM imports i JOIN fp USING (path) WHERE pkg = 'com.acme' AND package <> 'com.acme'),
    uses AS (SELECT o.name, x.path FROM one o, (SELECT DISTINCT path FROM far WHERE wild) x UNION SELECT target, path FROM far WHERE NOT wild)
    SELECT o.name, count(DISTINCT u.path) AS importer_count FROM one o JOIN uses u USING (name) GROUP BY o.name"""
)
def cmd_api(spark, sf):
    """A package's names with the files of other packages that import them; wildcards count for every name."""
    return ask(spark, sf, "api", "com.acme").parts["exported"].select("name", "importer_count")


@market(" SELECT CASE WHEN package = 'com.acme' THEN '(root)' ELSE substr(package, 10) END AS sub_package, count(*) AS symbol_count FROM sym WHERE package = 'com.acme' OR starts_with(package, 'com.acme.') GROUP BY 1")
def cmd_summary(spark, sf):
    return ask(spark, sf, "summary", "acme").parts["packages"]


_COMMON = ", ".join(f"'{x}'" for x in COMMON_PARENTS)


@market(
    f""", s AS (SELECT * FROM st WHERE NOT is_test), e AS (SELECT package, lower(unnest(parents)) AS parent FROM s),
    known AS (SELECT lower(name) AS parent FROM sym GROUP BY 1 HAVING NOT bool_and(regexp_matches(lower(package), '^(java|javax|scala)([.]|$)')))
    SELECT parent, count(DISTINCT package) AS packages, count(*) AS implementations FROM e WHERE length(parent) > 1 AND parent NOT IN ({_COMMON}) AND parent IN (SELECT parent FROM known) GROUP BY parent
    ORDER BY packages DESC, implementations DESC, parent LIMIT 6"""
)
def cmd_overview(spark, sf):
    """The types most extended, without tests, common parents, and types that only libraries define."""
    r = ask(spark, sf, "overview", limit=6).parts["most_extended"]
    return r.select(F.lower("name").alias("parent"), "packages", "implementations")


@market(" , fp AS (SELECT path, min(package) AS package FROM sym GROUP BY path), e AS (SELECT DISTINCT f.package AS src, i.pkg AS dst FROM imports i JOIN fp f USING (path) WHERE f.package <> i.pkg AND f.package <> '') SELECT src, string_agg(dst, ',' ORDER BY dst) AS deps FROM e GROUP BY src")
def cmd_overview_dependencies(spark, sf):
    r = ask(spark, sf, "overview", architecture=True).parts["dependencies"]
    return r.select("src", F.array_join("deps", ",").alias("deps"))


@market(
    """, cand AS (SELECT name, path, line, 0 AS r, 'MainAnnotation' AS category FROM sym WHERE k % 9 = 0 UNION ALL SELECT name, path, line, 1, 'ExtendsApp' FROM st WHERE list_contains(list_transform(parents, lambda x: lower(x)), 'app')
    UNION ALL SELECT s.name, s.path, s.line, 2, 'MainMethod' FROM sym s JOIN mem m ON m.path = s.path AND m.owner = s.name AND m.name = 'main' AND m.kind = 'def' AND m.owner_kind = 'object' WHERE s.kind = 'object'
    UNION ALL SELECT name, path, line, 3, 'TestSuite' FROM st WHERE list_contains(parents, 'AnyFunSuite')),
    one AS (SELECT name, path, line, min(r) AS r FROM cand GROUP BY ALL), named AS (SELECT DISTINCT o.*, category FROM one o JOIN cand USING (name, path, line, r))
    SELECT name, path, line, category FROM named QUALIFY row_number() OVER (PARTITION BY category ORDER BY path, line, name) <= 12"""
)
def cmd_entrypoints(spark, sf):
    """The first of each way in; a symbol counts for the first that it fits."""
    return ask(spark, sf, "entrypoints", limit=12).parts["entrypoints"].select("name", "path", "line", "category")


@market(" SELECT low AS name_lc, imports FROM pop")
def import_popularity_renamed(spark, sf):
    """Names as they are in their packages, whatever they are renamed to."""
    return imports.popularity(MarketTables(spark, sf).imports)


@market(r" SELECT DISTINCT path FROM lns, (SELECT name AS n FROM sym WHERE k = 16) w WHERE regexp_matches(text, '(^|[^\p{L}\p{Nd}_])' || n || '($|[^\p{L}\p{Nd}_])')")
def token_screen_texts(spark, sf):
    return lines.screened(MarketTables(spark, sf).texts, named(spark, sf, 16)).select("path")


@market(f" SELECT owner, name, kind, ord, path FROM mem QUALIFY row_number() OVER (PARTITION BY path, owner, owner_line ORDER BY {MEMBER_ORDER}) <= 2")
def members_ranked(spark, sf):
    m = MarketTables(spark, sf).members
    return lookup.per_group(m, ["path", "owner", "owner_line"], lookup.member_order(), 2).select("owner", "name", "kind", "ord", "path")


@market(f"{_WALK}, up(node) AS (SELECT n FROM w UNION SELECT parent FROM up JOIN tg ON child = node), own AS (SELECT name, kind FROM mem WHERE lower(owner) = (SELECT n FROM w)) SELECT name, kind, lower(owner) AS from_owner FROM mem WHERE lower(owner) IN (SELECT node FROM up WHERE node <> (SELECT n FROM w)) AND (name, kind) NOT IN (SELECT name, kind FROM own)")
def inherited_deep(spark, sf):
    """Members of all ancestors, which lie more than five levels up in larger tables."""
    t = MarketTables(spark, sf)
    edges = t.symbols.where(F.col("kind").isin(*lookup.TYPE_KINDS)).select(F.lower("name").alias("child"), F.explode("parents").alias("p")).select("child", F.lower("p").alias("parent"))
    return hierarchy.inherited(t.members.select(F.lower("owner").alias("owner"), "name", "kind"), edges, named(spark, sf, 16).lower())


@market(f"{_HITS} SELECT path, line, confidence FROM lv ORDER BY {_CONF}, path, line LIMIT 15")
def refs_flat_order(spark, sf):
    t, name = MarketTables(spark, sf), named(spark, sf, 16)
    rated = refs.confident(refs.references(t.texts, name, aliases=t.aliases), name, lookup.by_name(t.symbols, name).select("package"), t.files, t.imports)
    return lookup.limited(refs.flat_order(rated), 15).select("path", "line", "confidence")
