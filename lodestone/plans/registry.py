"""Queries of the operators over the test tables, each with the SQL that must give the same rows.

Test tables play the roles of a code index: documents are source texts, parts are symbols (brand as package, type as kind), nations,
suppliers and customers form a type hierarchy, links of pages are imports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hierarchy, imports, lines, lookup, refs, summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- adapters: test tables in the roles of an index ---------------------------------------------------


def texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")


def symbols(spark, sf):
    """Parts: name without blanks and capitalised (``ColdRod``), kind by type, package by brand."""
    p = table(spark, sf, "part")
    none = F.array().cast("array<string>")
    return p.select(
        F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("name"), F.lower("p_type").alias("kind"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("path"),
        F.col("p_size").alias("line"), F.lower("p_brand").alias("package"), none.alias("parents"), none.alias("type_param_parents"),
        F.concat(F.lit("def part(size: Int): "), F.col("p_type")).alias("signature"), F.array("p_brand").alias("annotations"),
    )


def family(spark, sf):
    """(child, parent): customers and suppliers below nations below regions."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    up = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    s = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("child"), F.col("n_name").alias("parent"))
    c = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("child"), F.col("n_name").alias("parent"))
    return up.unionByName(s).unionByName(c)


def links(spark, sf):
    """Links of pages as imports: path, import_text."""
    p = table(spark, sf, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select(F.col("page_id").alias("path"), F.explode(found).alias("import_text"))


def trade(spark, sf):
    """(src, dst): nations of suppliers and of the customers they sell to."""
    li, o, s, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer", "nation"))
    sn, cn = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("dst"))
    e = li.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = e.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return e.select("s_nationkey", "c_nationkey").distinct().join(sn, "s_nationkey").join(cn, "c_nationkey").select("src", "dst")


LINES_SQL = "lines AS (SELECT doc_id AS path, unnest(regexp_split_to_array(text, '\\r?\\n')) AS text, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS line FROM documents)"
WORD_SQL = r"regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}]){0}($|[^\p{{L}}\p{{Nd}}])')"
STRICT_SQL = r"regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}_$]){0}($|[^\p{{L}}\p{{Nd}}_$])')"
PARTS_SQL = "parts AS (SELECT replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ' ', '') AS name, lower(p_type) AS kind, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS path, p_size AS line, lower(p_brand) AS package, 'def part(size: Int): ' || p_type AS signature, p_brand FROM part)"
FAMILY_SQL = """family AS (
  SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
TRADE_SQL = """trade AS (SELECT DISTINCT s.n_name AS src, c.n_name AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey)"""
LINKS_SQL = """links AS (SELECT page_id AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS import_text FROM pages)"""
_TRIM = "trim(text, ' ')"
_CATEGORY = rf"""CASE WHEN regexp_matches({_TRIM}, '^(trait|class|object|enum|given|type|def|val|var)\s') AND (regexp_matches({_TRIM}, '(trait|class|object|enum|type) that') OR regexp_matches({_TRIM}, 'given\s+\w*\s*that')) THEN 'Definition'
  WHEN regexp_matches({_TRIM}, '\b(extends|with)\b') THEN 'ExtendedBy' WHEN starts_with({_TRIM}, 'import ') THEN 'ImportedBy'
  WHEN starts_with({_TRIM}, '//') OR starts_with({_TRIM}, '/*') OR starts_with({_TRIM}, '*') THEN 'Comment'
  WHEN regexp_matches({_TRIM}, ':\s*that|\[that') THEN 'UsedAsType' ELSE 'Usage' END"""
HITS_SQL = f"hits AS (SELECT path, CAST(line AS INTEGER) AS line, {_TRIM} AS context, {_CATEGORY} AS category FROM lines WHERE {WORD_SQL.format('that')})"


# --- scans, grep ------------------------------------------------------------------------------------


@query(f"WITH {LINES_SQL} SELECT path, CAST(line AS INTEGER) AS line, {_TRIM} AS text FROM lines WHERE regexp_matches(text, '[Ll]icen[cs]ed? under')")
def grep_lines(spark, sf):
    return lines.grep(lines.lines(texts(spark, sf)), "[Ll]icen[cs]ed? under")


@query(f"WITH {LINES_SQL} SELECT count(*) AS matches, count(DISTINCT path) AS files FROM lines WHERE regexp_matches(text, '\\d{{3,}}')")
def grep_count(spark, sf):
    return lines.grep_count(lines.lines(texts(spark, sf)), r"\d{3,}")


@query(f"WITH {LINES_SQL} SELECT path, CAST(line AS INTEGER) AS line, {_TRIM} AS text FROM lines WHERE regexp_matches(text, 'License|\\[oops')")
def grep_multi(spark, sf):
    """Several patterns; one of them is no valid regex and is taken literally."""
    return lines.grep(lines.lines(texts(spark, sf)), T.grep_pattern(spark, ["License", "[oops"]))


@query(
    f"""WITH {LINES_SQL}, hits AS (SELECT path, line FROM lines WHERE regexp_matches(text, 'License')),
    want AS (SELECT path, line AS hit, unnest(range(line - 1, line + 2)) AS line FROM hits)
    SELECT path, CAST(hit AS INTEGER) AS hit, CAST(line AS INTEGER) AS line, text, line = hit AS is_match FROM want JOIN lines USING (path, line)"""
)
def grep_context(spark, sf):
    rows = lines.lines(texts(spark, sf))
    return lines.with_context(rows, lines.grep(rows, "License"), 1)


@query(f"WITH {LINES_SQL} SELECT path, count(*) AS n_lines FROM lines GROUP BY path")
def line_scan(spark, sf):
    return lines.lines(texts(spark, sf)).groupBy("path").agg(F.count("*").alias("n_lines"))


@query(r"SELECT doc_id AS path, CAST(count(DISTINCT t) AS BIGINT) AS n_tokens FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}_][\p{L}\p{Nd}_]+')) AS t FROM documents) GROUP BY doc_id")
def token_index(spark, sf):
    return lines.tokens(texts(spark, sf)).groupBy("path").agg(F.count("*").alias("n_tokens"))


@query(r"SELECT doc_id AS path FROM documents WHERE list_contains(regexp_extract_all(text, '[\p{L}_][\p{L}\p{Nd}_]+'), 'License')")
def token_screen(spark, sf):
    return lines.screened(texts(spark, sf), "License").select("path")


@query(
    """WITH turns AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations),
    spans AS (SELECT conv_id, min(line) AS a, min(line) + 1 AS b FROM turns WHERE role = 'assistant' GROUP BY conv_id)
    SELECT conv_id AS path, CAST(line AS INTEGER) AS line, t.text, CAST(a AS INTEGER) AS start_line FROM turns t JOIN spans USING (conv_id) WHERE line BETWEEN a AND b"""
)
def body_range_join(spark, sf):
    """Lines of a text that lie inside spans of it: turns as lines, the first answer and what follows it as a span."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations")
    rows = c.select(F.col("conv_id").alias("path"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("line"), "text", "role")
    spans = rows.where("role = 'assistant'").groupBy("path").agg(F.min("line").alias("start_line")).withColumn("end_line", F.col("start_line") + 1)
    return lines.in_spans(rows.select("path", "line", "text"), spans, ["start_line"])


# --- references -------------------------------------------------------------------------------------


def _refs(spark, sf, strict=False):
    return refs.categorised(refs.references(texts(spark, sf), "that", strict), "that")


@query(f"WITH {LINES_SQL}, {HITS_SQL} SELECT path, line, context, category FROM hits")
def refs_flat(spark, sf):
    return _refs(spark, sf).drop("alias")


@query(f"WITH {LINES_SQL}, {HITS_SQL} SELECT category, count(*) AS \"count\" FROM hits GROUP BY category")
def refs_count(spark, sf):
    return refs.per_category(_refs(spark, sf))


@query(f"WITH {LINES_SQL}, {HITS_SQL} SELECT path, count(*) AS \"count\" FROM hits GROUP BY path ORDER BY 2 DESC, path LIMIT 10")
def refs_top(spark, sf):
    return refs.per_file(_refs(spark, sf), 10)


@query(f"WITH {LINES_SQL} SELECT path, CAST(line AS INTEGER) AS line, {_TRIM} AS context FROM lines WHERE {STRICT_SQL.format('that')}")
def refs_strict(spark, sf):
    return refs.references(texts(spark, sf), "that", strict=True).drop("alias")


@query(
    f"""WITH {LINES_SQL}, {HITS_SQL}, t AS (SELECT path, doc_id FROM hits JOIN labels ON doc_id = path WHERE quality = 1)
    SELECT count(*) AS reference_count, count(DISTINCT path) AS test_file_count FROM t"""
)
def coverage(spark, sf):
    """References in labelled good documents, which stand for tests."""
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("path")).distinct()
    found = refs.references(texts(spark, sf), "that").join(good.withColumn("is_test", F.lit(True)), "path", "left")
    return refs.coverage(found, F.coalesce("is_test", F.lit(False)))


@query(
    f"""WITH {LINES_SQL}, hits AS (SELECT path, CAST(line AS INTEGER) AS line, CASE WHEN {WORD_SQL.format('that')} THEN NULL ELSE 'with' END AS alias FROM lines
      WHERE {WORD_SQL.format('that')} OR (path % 2 = 0 AND {WORD_SQL.format('with')}))
    SELECT path, line, alias FROM hits"""
)
def refs_alias(spark, sf):
    """Texts of even ids know ``that`` under the alias ``with`` too."""
    t = texts(spark, sf)
    aliases = t.where("path % 2 = 0").select("path", F.lit("that").alias("original"), F.lit("with").alias("alias"))
    return refs.references(t, "that", aliases=aliases).select("path", "line", "alias")


@query(
    f"""WITH {LINES_SQL}, {HITS_SQL}, f AS (SELECT doc_id AS path, source AS package FROM documents),
    i AS (SELECT doc_id AS path, lang FROM documents)
    SELECT path, line, CASE WHEN package = 'src1' THEN 'High' WHEN lang = 'en' THEN 'Medium' ELSE 'Low' END AS confidence FROM hits JOIN f USING (path) JOIN i USING (path)"""
)
def refs_confidence(spark, sf):
    """Sources as packages; English documents import all of ``src1``."""
    d = table(spark, sf, "documents")
    files = d.select(F.col("doc_id").alias("path"), F.col("source").alias("package"))
    imp = imports.parsed(d.where("lang = 'en'").select(F.col("doc_id").alias("path"), F.lit("import src1._").alias("import_text")))
    found = refs.references(texts(spark, sf), "that")
    return refs.confident(found, "that", spark.createDataFrame([("src1",)], "package string"), files, imp).select("path", "line", "confidence")


# --- lookup and ranking --------------------------------------------------------------------------------

#: Camel case as a plain pattern, which says the same for names of two segments.
_TIER = """CASE WHEN lower(name) = '{q}' THEN 1 WHEN starts_with(lower(name), '{q}') THEN 2 WHEN contains(lower(name), '{q}') THEN 3
  WHEN length(name) >= 3 AND length(name) > {h} AND ends_with('{q}', lower(name)) THEN 4 WHEN regexp_matches(name, '{camel}') THEN 5 END"""


@query(
    f"""WITH {PARTS_SQL}, t AS (SELECT name, kind, path, line, package, {_TIER.format(q='cold', h=2, camel='^[cC]([oO]|.+O)([lL]|.+L)([dD]|.+D)')} AS tier FROM parts)
    SELECT name, path, line, package, tier FROM t WHERE tier IS NOT NULL"""
)
def search_tiers(spark, sf):
    return lookup.search(symbols(spark, sf), "Cold").select("name", "path", "line", "package", "tier")


@query(
    f"""WITH {PARTS_SQL}, t AS (SELECT name, path, line, {_TIER.format(q='cr', h=1, camel='^[cC]([rR]|.+R)')} AS tier FROM parts)
    SELECT name, path, line, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, CASE WHEN tier = 5 THEN length(name) END, path, line, name LIMIT 20"""
)
def search_ranked(spark, sf):
    hit = lookup.search(symbols(spark, sf), "CR")
    return lookup.limited(hit.orderBy(*lookup.search_order()), 20).select("name", "path", "line", "tier")


@query(f"WITH {PARTS_SQL}, t AS (SELECT name, path, line, package, {_TIER.format(q='cr', h=1, camel='^[cC]([rR]|.+R)')} AS tier FROM parts) SELECT name, path, line, package, tier FROM t WHERE tier IS NOT NULL")
def search_all_tiers(spark, sf):
    """Camel case mostly; tests hold it against a brute-force version too."""
    return lookup.search(symbols(spark, sf), "CR").select("name", "path", "line", "package", "tier")


@query()
def file_search_all(spark, sf):
    """Names as file names, by all tiers."""
    names = symbols(spark, sf).select(F.concat(F.lit("src/"), "name", F.lit(".scala")).alias("path"))
    return lookup.limited(lookup.file_search(names, "CR"), 30)


@query(f"WITH {PARTS_SQL} SELECT name, path FROM parts WHERE regexp_matches(name, '^[cC]([rR]|.+R)')")
def search_camel(spark, sf):
    """Camel-case match alone. Names here have two segments, so a simple pattern says the same."""
    s = symbols(spark, sf)
    return s.where(T.camel_match(F.col("name"), "CR")).select("name", "path")


@query(f"WITH {PARTS_SQL}, s AS (SELECT name, path FROM parts WHERE lower(name) = (SELECT min(lower(name)) FROM parts)) SELECT name, path FROM s")
def def_lookup(spark, sf):
    s = symbols(spark, sf)
    first = s.agg(F.min(F.lower("name"))).first()[0]
    return lookup.by_name(s, first).orderBy(*lookup.definition_order()).select("name", "path")


@query(f"WITH {PARTS_SQL}, k AS (SELECT package, name FROM parts ORDER BY package, name LIMIT 1) SELECT p.name, p.path, p.package FROM parts p JOIN k USING (package, name)")
def def_qualified(spark, sf):
    s = symbols(spark, sf)
    k = s.orderBy("package", "name").select("package", "name").first()
    return lookup.by_name(s, f"{k.package}.{k.name}").select("name", "path", "package")


@query(f"WITH {PARTS_SQL} SELECT name, path FROM parts WHERE lower(p_brand) = 'brand#13'")
def annotated(spark, sf):
    return lookup.annotated(symbols(spark, sf), "@Brand#13").select("name", "path")


@query(f"WITH {PARTS_SQL} SELECT name, path FROM parts WHERE contains(lower(substr(signature, 22)), 'e')")
def signature_returns(spark, sf):
    s = symbols(spark, sf)
    return s.where(T.returns(F.col("signature"), "E") & T.takes(F.col("signature"), "INT")).select("name", "path")


@query(f"WITH {PARTS_SQL} SELECT name, kind, path FROM parts WHERE package = 'brand#13' ORDER BY name, path LIMIT 50")
def package_symbols(spark, sf):
    """The first symbols of a whole package."""
    s = symbols(spark, sf)
    own = s.join(F.broadcast(lookup.package_match(s, "BRAND#13")), "package", "left_semi")
    return lookup.limited(own.orderBy("name", "path"), 50).select("name", "kind", "path")


@query(f"WITH {PARTS_SQL}, f AS (SELECT DISTINCT path FROM parts WHERE contains(path, '12')) SELECT path, CASE WHEN starts_with(path, '12') THEN 2 ELSE 3 END AS tier FROM f ORDER BY tier, path LIMIT 30")
def file_search(spark, sf):
    return lookup.limited(lookup.file_search(symbols(spark, sf), "12"), 30)


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"""
)
def per_group_limit(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return lookup.per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 40 OFFSET 100")
def members_page(spark, sf):
    li = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lookup.limited(li, 40, 100).select("l_orderkey", "l_linenumber", "l_partkey")


# --- hierarchy and graphs ------------------------------------------------------------------------------


def family_symbols(spark, sf):
    """The family as symbols with parents."""
    none = F.array().cast("array<string>")
    return family(spark, sf).select(
        F.col("child").alias("name"), F.lit("class").alias("kind"), F.col("child").alias("path"), F.lit(1).alias("line"), F.col("parent").alias("package"), F.array("parent").alias("parents"), none.alias("type_param_parents")
    )


@query(f"WITH {FAMILY_SQL} SELECT child AS name, parent AS package FROM family WHERE parent = 'NATION_6'")
def impl_direct(spark, sf):
    """All implementations of one type, by a name in another case."""
    return lookup.implementations(family_symbols(spark, sf), "nation_6").select("name", "package")


@query(f"WITH {FAMILY_SQL} SELECT lower(parent) AS parent_lc, count(*) AS implementations FROM family GROUP BY parent")
def impl_counts(spark, sf):
    return lookup.type_edges(family_symbols(spark, sf)).groupBy("parent_lc").agg(F.count("*").alias("implementations"))


@query(
    f"""WITH RECURSIVE {FAMILY_SQL}, w(depth, node, path) AS (
      SELECT 0, (SELECT min(s_name) FROM supplier), [(SELECT min(s_name) FROM supplier)]
      UNION ALL SELECT depth + 1, parent, list_append(path, parent) FROM w JOIN family ON child = node WHERE depth < 5 AND NOT list_contains(path, parent))
    SELECT depth, node, array_to_string(path, '>') AS path FROM w"""
)
def hierarchy_up(spark, sf):
    root = table(spark, sf, "supplier").agg(F.min("s_name")).first()[0]
    return hierarchy.walk(family(spark, sf), root).withColumn("path", F.array_join("path", ">"))


@query(
    f"""WITH RECURSIVE {FAMILY_SQL}, w(depth, node, path) AS (
      SELECT 0, 'ASIA', ['ASIA'] UNION ALL SELECT depth + 1, child, list_append(path, child) FROM w JOIN family ON parent = node WHERE depth < 2 AND NOT list_contains(path, child))
    SELECT depth, node, array_to_string(path, '>') AS path FROM w"""
)
def hierarchy_down(spark, sf):
    return hierarchy.walk(family(spark, sf), "ASIA", 2, down=True).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {FAMILY_SQL} SELECT n.child AS node, count(*) AS hidden FROM family n JOIN family c ON c.parent = n.child WHERE n.parent = 'ASIA' GROUP BY n.child")
def hierarchy_truncated(spark, sf):
    f = family(spark, sf)
    return hierarchy.truncated(f, hierarchy.walk(f, "ASIA", 1, down=True), 1).select("node", "hidden")


@query(
    f"""WITH {TRADE_SQL}, one AS (SELECT DISTINCT dst AS node FROM trade WHERE src = 'NATION_6' AND dst <> 'NATION_6'),
    two AS (SELECT DISTINCT dst AS node FROM trade JOIN one ON src = node WHERE dst <> 'NATION_6' AND dst NOT IN (SELECT node FROM one))
    SELECT 'NATION_6' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two"""
)
def deps_cyclic(spark, sf):
    """Transitive dependencies in a graph full of cycles: each node once, with its least depth."""
    return hierarchy.reach(trade(spark, sf), spark.createDataFrame([("NATION_6",)], "node string"), 2)


@query(f"WITH {FAMILY_SQL}, d AS (SELECT child AS node, 1 AS o, 0 AS i FROM family UNION ALL SELECT parent, 0, 1 FROM family) SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM d GROUP BY node")
def graph_degrees(spark, sf):
    return hierarchy.degrees(family(spark, sf).toDF("src", "dst"))


@query(f"WITH {FAMILY_SQL} SELECT DISTINCT parent AS node FROM family WHERE parent NOT IN (SELECT child FROM family)")
def graph_sinks(spark, sf):
    return hierarchy.sinks(family(spark, sf).toDF("src", "dst"))


@query(f"WITH {FAMILY_SQL} SELECT DISTINCT child AS node FROM family WHERE child NOT IN (SELECT parent FROM family)")
def graph_sources(spark, sf):
    return hierarchy.sources(family(spark, sf).toDF("src", "dst"))


@query(
    f"""WITH {FAMILY_SQL}, r AS (SELECT DISTINCT parent AS node FROM family WHERE parent NOT IN (SELECT child FROM family)), n AS (SELECT DISTINCT child AS node FROM family JOIN r ON parent = node)
    SELECT node, 0 AS level FROM r UNION ALL SELECT node, 1 FROM n UNION ALL SELECT DISTINCT child, 2 FROM family JOIN n ON parent = node"""
)
def graph_levels(spark, sf):
    return hierarchy.levels(family(spark, sf).toDF("src", "dst"))


@query(f"WITH {FAMILY_SQL}, {TRADE_SQL} SELECT 'family' AS graph, TRUE AS acyclic UNION ALL SELECT 'trade', count(*) = 0 FROM trade a JOIN trade b ON a.src = b.dst AND a.dst = b.src")
def graph_acyclic(spark, sf):
    found = [(n, hierarchy.is_acyclic(e)) for n, e in (("family", family(spark, sf).toDF("src", "dst")), ("trade", trade(spark, sf)))]
    return spark.createDataFrame(found, "graph string, acyclic boolean")


@query(
    """WITH own AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 2)),
    nation_parts AS (SELECT DISTINCT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 2)
    SELECT l_partkey AS name FROM nation_parts WHERE l_partkey NOT IN (SELECT l_partkey FROM own)"""
)
def inherited_minus_own(spark, sf):
    """Parts that suppliers of a nation sell, as members of the nation; those of one supplier hide theirs."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.concat(F.lit("n"), "s_nationkey").alias("owner"), F.col("l_partkey").alias("name"))
    own = li.select(F.concat(F.lit("s"), "l_suppkey").alias("owner"), F.col("l_partkey").alias("name"))
    members = own.unionByName(nation).distinct().withColumn("kind", F.lit("def"))
    edges = s.select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    root = s.where("s_nationkey = 2").agg(F.min("s_suppkey")).first()[0]
    return hierarchy.inherited(members, edges, f"s{root}").select("name")


@query(
    f"""WITH {FAMILY_SQL}, {TRADE_SQL} SELECT parent, count(DISTINCT substr(child, 1, 10)) AS packages, count(*) AS implementations FROM family GROUP BY parent
    ORDER BY packages DESC, implementations DESC, parent LIMIT 10"""
)
def most_extended(spark, sf):
    f = family(spark, sf).withColumn("package", F.substring("child", 1, 10))
    return hierarchy.most_extended(f, 10)


@query("SELECT l_suppkey AS owner, l_partkey AS name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) WHERE l_partkey = 7 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def overrides(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("name")).distinct()
    children = table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("owner"))
    return hierarchy.overrides(members, children, 7)


# --- imports -----------------------------------------------------------------------------------------


@query(
    rf"""WITH {LINKS_SQL}, t AS (SELECT path, 'import web.' || replace(import_text, '/', '.') AS text, row_number() OVER (PARTITION BY path ORDER BY import_text) AS line FROM links WHERE import_text <> '' AND NOT contains(import_text, ':')),
    w AS (SELECT min(regexp_extract(text, '([A-Za-z0-9]+)$', 1)) AS n FROM t WHERE regexp_matches(text, '[A-Za-z0-9]+$'))
    SELECT path, CAST(line AS INTEGER) AS line, text AS context FROM t, w WHERE regexp_matches(text, '(^|[^\p{{L}}\p{{Nd}}])' || n || '($|[^\p{{L}}\p{{Nd}}])')"""
)
def imports_pages(spark, sf):
    """Links as import lines of their pages; who imports one name."""
    found = links(spark, sf).where("import_text <> '' and not contains(import_text, ':')")
    rows = found.groupBy("path").agg(F.sort_array(F.collect_list("import_text")).alias("x"))
    t = rows.select("path", F.array_join(F.transform("x", lambda x: F.concat(F.lit("import web."), F.replace(x, F.lit("/"), F.lit(".")))), "\n").alias("text"))
    every = lines.lines(t).select(F.regexp_extract("text", "([A-Za-z0-9]+)$", 1).alias("n")).where("n <> ''")
    name = every.agg(F.min("n")).first()[0]
    none = imports.parsed(spark.createDataFrame([], "path long, import_text string"))
    return imports.importers(t, name or "none", spark.createDataFrame([], "package string"), none).select("path", "line", "context")


@query(f"WITH {LINKS_SQL} SELECT lower(regexp_replace(import_text, '^.*\\.', '')) AS name_lc, count(*) AS imports FROM links WHERE regexp_replace(import_text, '^.*\\.', '') <> '' GROUP BY 1")
def import_popularity(spark, sf):
    plain = links(spark, sf)
    return imports.popularity(imports.parsed(plain))


@query(
    r"""WITH t(path, import_text) AS (VALUES (1, 'import a.b.C'), (2, 'import a.b._'), (3, 'import a.b.{C, D as E, F => G}'), (4, 'import a.*'), (5, 'import a.b.{H, _}'))
    SELECT path, pkg, names, is_wildcard FROM (VALUES (1, 'a.b', 'C', false), (2, 'a.b', '', true), (3, 'a.b', 'C,D,F', false), (4, 'a', '', true), (5, 'a.b', 'H', true)) v(path, pkg, names, is_wildcard)"""
)
def import_parse(spark, sf):
    given = [(1, "import a.b.C"), (2, "import a.b._"), (3, "import a.b.{C, D as E, F => G}"), (4, "import a.*"), (5, "import a.b.{H, _}")]
    return imports.parsed(spark.createDataFrame(given, "path int, import_text string")).select("path", "pkg", F.array_join("names", ",").alias("names"), "is_wildcard")


@query(
    """WITH p AS (SELECT p_partkey, p_name AS name FROM part WHERE p_brand = 'Brand#13'), u AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    one AS (SELECT name, min(p_partkey) AS path FROM p GROUP BY name)
    SELECT one.name, CAST(one.path AS VARCHAR) AS path, count(DISTINCT o_custkey) AS importer_count FROM one LEFT JOIN p USING (name) LEFT JOIN u ON l_partkey = p_partkey GROUP BY ALL"""
)
def api_surface(spark, sf):
    """Parts of one brand as a package's names, customers who order them as importing files."""
    p = table(spark, sf, "part")
    syms = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path"), F.lit(1).alias("line"), F.col("p_type").alias("kind"), F.col("p_brand").alias("package"))
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    used = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.col("o_custkey").alias("path"), F.col("p_brand").alias("pkg"), F.array("p_name").alias("names"), F.lit(False).alias("is_wildcard")).distinct()
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("customers."), "c_mktsegment").alias("package"))
    return imports.api_surface(syms, "Brand#13", used, files).select("name", F.col("path").cast("string").alias("path"), "importer_count")


@query(
    """WITH p AS (SELECT p_partkey, p_name AS name FROM part WHERE p_brand = 'Brand#13'), u AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')
    SELECT name, count(DISTINCT o_custkey) AS importer_count FROM p LEFT JOIN u ON l_partkey = p_partkey GROUP BY name HAVING count(DISTINCT o_custkey) > 0"""
)
def api_used_by(spark, sf):
    p = table(spark, sf, "part")
    syms = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("path"), F.lit(1).alias("line"), F.col("p_type").alias("kind"), F.col("p_brand").alias("package"))
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    used = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.col("o_custkey").alias("path"), F.col("p_brand").alias("pkg"), F.array("p_name").alias("names"), F.lit(False).alias("is_wildcard")).distinct()
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("path"), F.concat(F.lit("customers."), "c_mktsegment").alias("package"))
    return imports.api_surface(syms, "Brand#13", used, files, used_by="building").where("importer_count > 0").select("name", "importer_count")


@query(f"WITH {TRADE_SQL} SELECT src, dst FROM trade WHERE src <> dst AND src IN (SELECT src FROM trade WHERE dst = 'NATION_6' UNION SELECT dst FROM trade WHERE src = 'NATION_6' UNION SELECT 'NATION_6') AND dst IN (SELECT src FROM trade WHERE dst = 'NATION_6' UNION SELECT dst FROM trade WHERE src = 'NATION_6' UNION SELECT 'NATION_6')")
def package_graph(spark, sf):
    e = trade(spark, sf)
    imp = e.select(F.col("src").alias("path"), F.concat(F.col("dst"), F.lit(".X")).alias("import_text"))
    files = table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("package"))
    return imports.package_graph(imp, files, focus="NATION_6")


# --- counts, differences, sinks ---------------------------------------------------------------------------


@query(f"WITH {PARTS_SQL} SELECT kind, count(*) AS \"count\" FROM parts GROUP BY kind")
def overview_kinds(spark, sf):
    return summary.count_by(symbols(spark, sf), "kind")


@query(f"WITH {PARTS_SQL} SELECT package, count(*) AS \"count\" FROM parts GROUP BY package ORDER BY 2 DESC, package LIMIT 5")
def top_packages(spark, sf):
    return summary.count_by(symbols(spark, sf), "package", 5)


@query(f"WITH {PARTS_SQL} SELECT count(DISTINCT path) AS files, count(*) AS symbols, count(DISTINCT package) AS packages FROM parts")
def index_totals(spark, sf):
    return summary.totals(symbols(spark, sf))


@query(f"WITH {PARTS_SQL} SELECT DISTINCT package FROM parts")
def packages(spark, sf):
    return symbols(spark, sf).select("package").where("package <> ''").distinct()


@query(
    """WITH s AS (SELECT r_name || '.' || n_name || '.' || c_mktsegment AS package FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT substr(package, 6) AS sub_package, count(*) AS symbol_count FROM s WHERE starts_with(package, 'ASIA.') GROUP BY 1"""
)
def summary_subpackages(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    s = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment").alias("package"))
    return summary.sub_packages(s, "ASIA")


@query(
    """WITH o AS (SELECT o_custkey, o_orderpriority, min(o_totalprice) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL),
    n AS (SELECT o_custkey, o_orderpriority, min(o_totalprice) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL)
    SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority,
      CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM o FULL JOIN n ON o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority WHERE o.p IS DISTINCT FROM n.p"""
)
def diff_snapshots(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return summary.difference(o.where(F.col("o_orderdate") < cut), o.where(F.col("o_orderdate") >= cut), ["o_custkey", "o_orderpriority"], ["o_totalprice"])


@query(
    """WITH b AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' AND value > 195 THEN 0 WHEN event_type = 'click' AND value > 180 THEN 1 WHEN event_type NOT IN ('purchase', 'click') THEN 2 END AS r FROM events),
    f AS (SELECT user_id, r FROM b WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r, event_id) = 1)
    SELECT CASE r WHEN 0 THEN 'large purchase' WHEN 1 THEN 'large click' ELSE 'rest' END AS category, count(*) AS n FROM f GROUP BY 1"""
)
def entrypoints_union(spark, sf):
    """Branches by priority; a user belongs to the first that has one of their events."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    branches = [
        ("large purchase", e.where("event_type = 'purchase' and value > 195")),
        ("large click", e.where("event_type = 'click' and value > 180")),
        ("rest", e.where("event_type not in ('purchase', 'click')")),
    ]
    return summary.first_branch(branches, ["user_id"], ["event_id"]).groupBy("category").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT o_orderpriority AS name, o_custkey AS path, o_orderkey AS line, CASE WHEN o_orderstatus = 'F' THEN 'class' ELSE 'object' END AS kind FROM orders)
    SELECT c.name, c.path, c.line AS of_line, min(o.line) AS line FROM s c JOIN s o ON c.name = o.name AND c.path = o.path AND c.kind = 'class' AND o.kind = 'object' GROUP BY ALL"""
)
def companion(spark, sf):
    """Orders as symbols: customer as file, priority as name; finished ones are classes, the others objects."""
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") == "F", "class").otherwise("object").alias("kind"), F.lit("p").alias("package"), F.lit("").alias("signature"))
    return lookup.companion(s, s.where("kind = 'class'")).select("name", "path", "of_line", "line")


@query("SELECT count(DISTINCT (user_id, event_type)) AS suites, count(*) FILTER (value <= 100) AS tests, count(*) FILTER (value > 100) AS dynamic_sites FROM events")
def suite_counts(spark, sf):
    """Users as files, event types as suites, large values as computed names."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("suite"), F.lit(1).alias("suite_line"), (F.col("value") > 100).alias("is_dynamic"))
    return summary.suites(e)


@query(f"WITH {TRADE_SQL} SELECT count(*) AS edges, count(DISTINCT src) AS packages FROM trade WHERE src <> dst")
def package_graph_totals(spark, sf):
    e = trade(spark, sf)
    imp = e.select(F.col("src").alias("path"), F.concat(F.col("dst"), F.lit(".X")).alias("import_text"))
    files = table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("package"))
    return summary.api_totals(imports.package_graph(imp, files))


@query(
    """WITH s AS (SELECT 'region.' || n_regionkey || '.' || lower(n_name) AS package, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    t AS (SELECT package, CASE WHEN ends_with(package, '.nation_1') THEN 1 WHEN contains(package, 'nation_1') THEN 2 END AS tier, count(DISTINCT name) AS names FROM s GROUP BY package)
    SELECT package FROM t WHERE tier IS NOT NULL ORDER BY tier, names DESC, package LIMIT 1"""
)
def package_match(spark, sf):
    """The best match of a package name; several only contain it, one ends with it."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    s = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("region."), "n_regionkey", F.lit("."), F.lower("n_name")).alias("package"), F.col("c_name").alias("name"))
    return lookup.package_match(s, "NATION_1")


@query(
    f"""WITH {FAMILY_SQL} SELECT child, parent FROM family QUALIFY row_number() OVER (PARTITION BY parent ORDER BY child) <= 5"""
)
def impl_limit(spark, sf):
    """The first implementations of each type."""
    return lookup.per_group(family(spark, sf), ["parent"], [F.col("child")], 5)
