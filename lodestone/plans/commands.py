"""The query commands over a code index: name → function(context, arguments) → ``Result``.

A result is a shape name, a header, and one or several DataFrames (``parts``); nothing is collected here but single values that decide
between plans. New commands join through ``register``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import hierarchy, imports, lines, lookup, refs, summary
from ..sources import git, scan
from ..sources.ingest import Stats, Tables

#: Parents that say nothing about a code base, and type names that are in scope everywhere; lower case.
COMMON_PARENTS = (
    "product", "serializable", "anyval", "anyref", "any", "matchable", "equals", "object", "enum", "throwable", "exception",
    "runtimeexception", "ioexception", "illegalargumentexception", "illegalstateexception", "unsupportedoperationexception",
    "nullpointerexception", "classcastexception", "indexoutofboundsexception", "error", "assertionerror", "stackoverflowerror", "outofmemoryerror",
    "comparable", "cloneable", "autocloseable", "closeable", "runnable", "callable", "iterable", "iterator",
    "function0", "function1", "function2", "function3", "partialfunction",
)
PREDEF = (
    "option", "list", "map", "set", "seq", "vector", "array", "either", "some", "none", "nil", "iterable", "iterator", "tuple",
    "boolean", "string", "int", "long", "double", "float", "byte", "short", "char", "unit", "nothing", "any", "anyref", "anyval",
)
TYPE_NAME = r"\b[A-Z][A-Za-z0-9]+\b"
LIBRARY = r"^(java|javax|scala)([.]|$)"
RELATED, EXPLAINED_MEMBERS = 10, 3


@dataclass(frozen=True)
class Flags:
    """Options of the commands, with their defaults."""

    limit: int = 20
    offset: int = 0
    kind: str | None = None
    no_tests: bool = False
    include_tests: bool = False
    path: str | None = None
    exclude_path: str | None = None
    in_package: str | None = None
    verbose: bool = False
    json: bool = False
    context: int = 0
    patterns: tuple[str, ...] = ()
    flat: bool = False
    count: bool = False
    top: int | None = None
    strict: bool = False
    category: str | None = None
    exact: bool = False
    prefix: bool = False
    definitions_only: bool = False
    returns: str | None = None
    takes: str | None = None
    inside: str | None = None  # --in
    of: str | None = None
    each_method: bool = False
    body: bool = False
    max_lines: int = 0
    with_imports: bool = False  # --imports
    shallow: bool = False
    no_doc: bool = False
    impl_limit: int = 5
    members_limit: int = 10
    expand: int = 0
    up: bool = False
    down: bool = False
    depth: int = -1
    inherited: bool = False
    brief: bool = False
    summary: bool = False
    related: bool = False
    explain: bool = False
    architecture: bool = False
    concise: bool = False
    focus_package: str | None = None
    has_method: str | None = None
    extends: str | None = None
    body_contains: str | None = None
    used_by: str | None = None
    max_output: int = 0
    timings: bool = False


@dataclass
class Result:
    shape: str
    header: str = ""
    parts: dict[str, DataFrame] = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    empty: str = ""
    hint: str = ""


@dataclass
class Context:
    tables: Tables
    flags: Flags = field(default_factory=Flags)
    root: str | None = None
    stats: Stats | None = None

    @property
    def spark(self):
        return self.tables.index.sparkSession

    def kept(self, rows: DataFrame, kind: bool = True) -> DataFrame:
        """The shared filters on symbol-like rows."""
        f = self.flags
        return lookup.kept(rows, f.kind if kind else None, f.no_tests, f.path, f.exclude_path, f.in_package)

    def kept_refs(self, rows: DataFrame) -> DataFrame:
        """The shared filters on rows with a path; rows of files that the index does not know are kept by the package filter."""
        f = self.flags
        rows = lines.filtered(rows, F.col("path"), f.no_tests, f.path, f.exclude_path)
        if f.in_package:
            own = self.tables.files.select("path", F.col("package").alias("_p"))
            rows = rows.join(own, "path", "left").where(F.col("_p").isNull() | T.in_package(F.col("_p"), f.in_package)).drop("_p")
        return rows


Command = Callable[[Context, list[str]], Result]
COMMANDS: dict[str, Command] = {}


def register(name: str):
    def add(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return add


def usage(text: str) -> Result:
    return Result("usage", f"Usage: {text}")


def not_found(what: str, ctx: Context, name: str) -> Result:
    near = lookup.limited(lookup.search(ctx.tables.symbols, name).orderBy(*lookup.search_order()), 5)
    return Result("not_found", what, {"suggestions": near.select("name", "kind", "path", "line", "package")})


def one(f: Callable[[Context, str], Result], text: str) -> Command:
    return lambda ctx, args: f(ctx, args[0]) if args else usage(text)


def _bodies(ctx: Context, rows: DataFrame, on: list[str]) -> DataFrame:
    """Adds body, body_start and body_end; bodies longer than ``--max-lines`` are left out."""
    b = ctx.tables.bodies.where(~F.col("is_abstract"))
    if ctx.flags.max_lines:
        b = b.where(F.col("end_line") - F.col("start_line") + 1 <= ctx.flags.max_lines)
    b = b.select("path", "owner", "name", F.col("start_line").alias("line"), F.col("text").alias("body"), F.col("start_line").alias("body_start"), F.col("end_line").alias("body_end"))
    return rows.join(b.dropDuplicates(on), on, "left")


# --- lookup ------------------------------------------------------------------------------------------


@register("index")
def index(ctx: Context, args: list[str]) -> Result:
    s = ctx.tables.symbols
    files = ctx.tables.files.agg(F.count("*").alias("file_count"), F.count_if("parse_failed").alias("parse_failures"))
    return Result("index", "", {"files": files, "totals": summary.totals(s), "kinds": summary.count_by(s, "kind"), "failed": ctx.tables.files.where("parse_failed").select("path").orderBy("path")}, {"stats": ctx.stats})


def popularity(ctx: Context) -> DataFrame:
    return imports.popularity(ctx.tables.imports)


@register("search")
def search(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("search <query>")
    f = ctx.flags
    hit = ctx.kept(lookup.search(ctx.tables.symbols, args[0], popularity(ctx), f.exact, f.prefix))
    if f.definitions_only:
        hit = lookup.kept(hit, types_only=True)
    if f.returns:
        hit = hit.where(T.returns(F.col("signature"), f.returns))
    if f.takes:
        hit = hit.where(T.takes(F.col("signature"), f.takes))
    return Result("symbols", f'Found symbols matching "{args[0]}":', {"symbols": hit.orderBy(*lookup.search_order())}, empty=f'Found 0 symbols matching "{args[0]}"')


def dotted_member(ctx: Context, name: str) -> DataFrame:
    """Members ``c`` of the type ``a.b`` for ``a.b.c``, as symbol rows."""
    owner, _, last = name.rpartition(".")
    types = lookup.by_name(ctx.tables.symbols, owner).where(F.lower("kind").isin(*lookup.TYPE_KINDS)).select("path", F.col("name").alias("owner"))
    none = F.array().cast("array<string>")
    m = ctx.tables.members.where(F.lower("name") == last.lower()).join(types.distinct(), ["path", "owner"], "left_semi")
    return m.select("name", "kind", "path", "line", "package", none.alias("parents"), none.alias("type_param_parents"), "signature", "annotations")


def resolve(ctx: Context, name: str, kind: bool = True) -> DataFrame:
    """Definitions of a name under the shared filters; of a dotted one also members, if nothing else is found."""
    found = ctx.kept(lookup.by_name(ctx.tables.symbols, name), kind)
    if "." not in name:
        return found
    cols = found.columns
    return lookup.first_stage([found, dotted_member(ctx, name).select(*cols)])


@register("def")
def definition(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("def <symbol>")
    found = resolve(ctx, args[0])
    if found.isEmpty():
        return not_found(f'Definition of "{args[0]}": not found', ctx, args[0])
    return Result("symbols", f'Definition of "{args[0]}":', {"symbols": found.orderBy(*lookup.definition_order())})


@register("impl")
def implementations(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("impl <type>")
    found = ctx.kept(lookup.implementations(ctx.tables.symbols, args[0]))
    return Result("symbols", f'Implementations of "{args[0]}":', {"symbols": found.orderBy(*lookup.LAST)}, empty=f'No implementations of "{args[0]}" found')


@register("symbols")
def symbols_of(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("symbols <file>")
    own = ctx.tables.symbols.where(F.col("path") == args[0])
    if ctx.flags.summary:
        return Result("counts", f"Symbols in {args[0]}:", {"counts": summary.count_by(own, "kind")})
    return Result("symbols", f"Symbols in {args[0]}:", {"symbols": own.orderBy("line", "name")}, {"all": True}, empty=f"No symbols found in {args[0]}")


@register("file")
def file(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("file <query>")
    found = lookup.file_search(ctx.tables.files, args[0])
    return Result("strings", f'Files matching "{args[0]}":', {"strings": found.select(F.col("path").alias("value"), "tier")}, empty=f'No files matching "{args[0]}"')


@register("packages")
def packages(ctx: Context, args: list[str]) -> Result:
    found = ctx.tables.symbols.select(F.col("package").alias("value")).where("value <> ''").distinct().orderBy("value")
    return Result("strings", "Packages:", {"strings": found}, {"all": True})


def _package(ctx: Context, wanted: str) -> str | None:
    row = lookup.package_match(ctx.tables.symbols, wanted).first()
    return row and row[0]


def no_package(ctx: Context, wanted: str) -> Result:
    """Suggests packages that hold one of the parts of the name, those with most names first."""
    parts = [p for p in wanted.lower().split(".") if p]
    own = ctx.tables.symbols.where("package <> ''").groupBy("package").agg(F.count_distinct("name").alias("names"))
    near = own.where(F.greatest(F.lit(False), F.lit(False), *[F.lower("package").contains(p) for p in parts])).orderBy(F.desc("names"), "package").limit(5)
    blank = F.lit("")
    return Result("not_found", f'Package "{wanted}" not found', {"suggestions": near.select(F.col("package").alias("name"), F.lit("package").alias("kind"), blank.alias("path"), F.lit(0).alias("line"), blank.alias("package"))})


@register("package")
def package(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("package <package>")
    name = _package(ctx, args[0])
    if name is None:
        return no_package(ctx, args[0])
    own = ctx.kept(ctx.tables.symbols.where(F.col("package") == name))
    if ctx.flags.definitions_only or ctx.flags.explain:
        own = lookup.kept(own, types_only=True)
    own = own.orderBy(*lookup.package_order())
    if not ctx.flags.explain:
        return Result("symbols", f"Package {name}:", {"symbols": own})
    edges = lookup.type_edges(ctx.tables.symbols).groupBy("parent_lc").agg(F.count_distinct("child_name", "child_path", "child_line").alias("impl_count"))
    rows = own.join(edges, F.lower("name") == F.col("parent_lc"), "left").drop("parent_lc").fillna(0, ["impl_count"])
    few = lookup.per_group(ctx.tables.members, ["path", "owner", "owner_line"], lookup.member_order(), EXPLAINED_MEMBERS)
    return Result("package_explained", f"Package {name}:", {"symbols": rows.orderBy(*lookup.package_order()), "members": few.where(F.col("package") == name)})


@register("annotated")
def annotated(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("annotated <annotation>")
    found = ctx.kept(lookup.annotated(ctx.tables.symbols, args[0]))
    name = args[0].removeprefix("@")
    return Result("symbols", f"Symbols annotated with @{name}:", {"symbols": found.orderBy(*lookup.LAST)}, empty=f"No symbols with @{name} annotation found")


# --- references and imports --------------------------------------------------------------------------


@register("refs")
def references(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("refs <symbol>")
    name, f, t = args[0].rpartition(".")[2], ctx.flags, ctx.tables
    if f.category and f.category.lower() not in [c.lower() for c in T.CATEGORIES]:
        return Result("references", f'References to "{name}"', {}, hint=f"Unknown category {f.category}; known are {', '.join(T.CATEGORIES)}")
    found = refs.categorised(refs.references(ctx.kept_refs(t.texts), name, f.strict, t.aliases), name)
    if f.category:
        found = found.where(F.lower("category") == f.category.lower())
    if f.top:
        return Result("refs_top", f'Files with most references to "{name}":', {"counts": refs.per_file(found, f.top)})
    if f.count:
        return Result("refs_count", f'References to "{name}":', {"counts": refs.per_category(found).orderBy(T.ranked(F.col("category"), T.DISPLAY_ORDER))})
    pkgs = lookup.by_name(t.symbols, args[0]).select("package")
    rated = refs.confident(found, name, pkgs, t.files, t.imports)
    if f.flat:
        return Result("references", f'References to "{name}":', {"references": refs.flat_order(rated)})
    order = [T.ranked(F.col("confidence"), T.CONFIDENCE_ORDER), T.ranked(F.col("category"), T.DISPLAY_ORDER), F.col("path"), F.col("line")]
    some = lookup.per_group(rated, ["confidence", "category"], [F.col("path"), F.col("line")], f.limit)
    return Result("references", f'References to "{name}":', {"references": some.orderBy(*order)}, {"grouped": True})


@register("imports")
def importing(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("imports <symbol>")
    pkgs = lookup.by_name(ctx.tables.symbols, args[0]).select("package")
    found = imports.importers(ctx.tables.texts, args[0].rpartition(".")[2], pkgs, ctx.tables.imports)
    return Result("references", f'Imports of "{args[0]}":', {"references": ctx.kept_refs(found).orderBy("path", "line")}, empty=f'No imports of "{args[0]}" found')


@register("coverage")
def coverage(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("coverage <symbol>")
    found = refs.references(ctx.tables.texts, args[0], aliases=ctx.tables.aliases)
    in_tests = found.where(T.is_test_path(F.col("path")))
    return Result("coverage", f'Coverage of "{args[0]}":', {"totals": refs.coverage(found, T.is_test_path(F.col("path"))), "references": in_tests.orderBy("path", "line")}, {"symbol": args[0]})


@register("grep")
def grep(ctx: Context, args: list[str]) -> Result:
    f = ctx.flags
    wanted = [*args[:1], *f.patterns] if not f.patterns or args else list(f.patterns)
    if not wanted:
        return usage("grep <pattern>")
    pattern = T.grep_pattern(ctx.spark, wanted)
    if f.inside:
        owner, _, member = f.inside.rpartition(".")
        spans = ctx.tables.bodies.where((F.col("name") == f.inside) if not owner else (F.lower("owner") == owner.rpartition(".")[2].lower()) & (F.col("name") == member)).select("path", "name", "kind", "start_line", "end_line")
        if f.each_method:
            m = ctx.tables.members.where(F.lower("owner") == f.inside.lower()).select("path", F.col("name").alias("method"), "signature", F.col("line").alias("start_line"), "end_line")
            hit = lines.in_spans(lines.lines(ctx.kept_refs(ctx.tables.texts)), m, ["method", "signature", "start_line"]).where(F.col("text").rlike(pattern))
            by = hit.groupBy("path", "method", "signature", "start_line").agg(F.count("*").alias("matches"), F.sort_array(F.collect_list(F.struct("line", F.trim("text").alias("text")))).alias("match_lines"))
            return Result("grep_methods", f"Matches in methods of {f.inside}:", {"methods": by.orderBy("path", "start_line")})
        rows = lines.in_spans(lines.lines(ctx.kept_refs(ctx.tables.texts)), spans, []).distinct()
    else:
        rows = lines.lines(lines.filtered(ctx.tables.texts, F.col("path"), f.no_tests, f.path, f.exclude_path))
    if f.count:
        return Result("grep_count", "", {"totals": lines.grep_count(rows, pattern)})
    hit = lines.grep(rows, pattern).withColumnRenamed("text", "context")
    return Result("references", f'Matches for "{pattern}":', {"references": hit.orderBy("path", "line")}, empty=f'No matches for "{pattern}"')


# --- members, bodies, docs -----------------------------------------------------------------------------


def _type_graph(ctx: Context) -> DataFrame:
    return ctx.tables.symbols.where(F.lower("kind").isin(*lookup.TYPE_KINDS)).select(F.lower("name").alias("child"), F.explode("parents").alias("p")).select("child", F.lower("p").alias("parent"))


def _inherited(ctx: Context, types: DataFrame, name: str) -> DataFrame:
    """Members of all ancestors of ``types``, which are called ``name``; of the types of an ancestor's name the best-ranked counts."""
    firsts = hierarchy.first_types(lookup.kept(ctx.tables.symbols, types_only=True), lookup.definition_order())
    up = lambda rows: rows.select("node", F.explode("parents").alias("p")).select(F.col("node").alias("src"), F.lower("p").alias("dst"))
    edges = up(firsts.where(F.col("node") != name)).unionByName(up(types.withColumn("node", F.lit(name))))
    above = hierarchy.reach(edges, ctx.spark.createDataFrame([(name,)], "node string"), None).where("depth > 0")
    owners = firsts.join(above.select("node"), "node", "left_semi").select("path", F.col("name").alias("owner"), F.lower("kind").alias("owner_kind"))
    return ctx.tables.members.join(owners.distinct(), ["path", "owner", "owner_kind"], "left_semi")


@register("members")
def members(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("members <type>")
    f, t = ctx.flags, ctx.tables
    types = lookup.kept(resolve(ctx, args[0]), types_only=True)
    if types.isEmpty():
        return not_found(f'No class/trait/object/enum "{args[0]}" found', ctx, args[0])
    keyed = types.select("path", F.col("name").alias("owner"), F.lower("kind").alias("owner_kind")).distinct()
    own = t.members.join(keyed, ["path", "owner", "owner_kind"], "left_semi").withColumn("inherited", F.lit(False))
    name = args[0].rpartition(".")[2].lower()
    if f.inherited:
        theirs = _inherited(ctx, types, name)
        redefined = theirs.select("name", "kind", F.lit(True).alias("_up")).distinct()
        own = own.join(redefined, ["name", "kind"], "left").withColumn("is_override", F.col("is_override") | F.coalesce("_up", F.lit(False))).drop("_up")
        theirs = theirs.join(own.select("name", "kind"), ["name", "kind"], "left_anti").withColumn("inherited", F.lit(True))
        own = own.unionByName(theirs)
    partner = lookup.companion(t.symbols, types).select("path", F.col("name").alias("owner"), F.lower("kind").alias("owner_kind"))
    friends = t.members.join(partner, ["path", "owner", "owner_kind"], "left_semi").join(keyed, ["path", "owner", "owner_kind"], "left_anti")
    if f.body:
        own, friends = (_bodies(ctx, x, ["path", "owner", "name", "line"]) for x in (own, friends))
    order = [F.col("inherited"), F.col("path"), F.col("owner_line"), F.col("ord")]
    return Result("members", f"Members of {args[0]}:", {"members": own.orderBy(*order), "companion": friends.orderBy("path", "ord")}, {"brief": f.brief})


@register("doc")
def doc(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("doc <symbol>")
    found = resolve(ctx, args[0])
    if found.isEmpty():
        return not_found(f'No definition of "{args[0]}" found', ctx, args[0])
    return Result("docs", "", {"docs": found.join(ctx.tables.docs, ["path", "line"], "left").orderBy(*lookup.definition_order()).select("name", "kind", "path", "line", "package", "doc")})


@register("body")
def body(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("body <symbol>")
    f, t = ctx.flags, ctx.tables
    b = ctx.kept_refs(t.bodies.drop("package"))
    types_of = lambda owner: lookup.kept(ctx.kept(lookup.by_name(t.symbols, owner), kind=False), types_only=True).select("path")
    # The files that define the name, and those of the owner asked for; if there are none, all files with types, as the name may be local to a body.
    defs = ctx.kept(lookup.by_name(t.symbols, args[0]), kind=False).select("path")
    every = lookup.kept(ctx.kept(t.symbols, kind=False), types_only=True).select("path")
    files = lookup.first_stage([defs.unionByName(types_of(f.inside)) if f.inside else defs, every]).distinct()
    found = b.where(F.col("name") == args[0]).join(files, "path", "left_semi")
    if f.inside:
        found = found.where(F.col("owner") == f.inside.rpartition(".")[2])
    elif "." in args[0]:
        owner, _, last = args[0].rpartition(".")
        of = b.where((F.col("name") == last) & (F.col("owner") == owner.rpartition(".")[2])).join(types_of(owner).distinct(), "path", "left_semi")
        found = lookup.first_stage([found, of])
    if f.context:
        around = lines.lines(ctx.tables.texts)
        before = found.select("path", "start_line", F.explode(F.sequence(F.col("start_line") - f.context, F.col("start_line") - 1)).alias("line"), F.lit("before").alias("side"))
        after = found.select("path", "start_line", F.explode(F.sequence(F.col("end_line") + 1, F.col("end_line") + f.context)).alias("line"), F.lit("after").alias("side"))
        extra = {"context": around.join(before.unionByName(after), ["path", "line"]).orderBy("path", "line")}
    else:
        extra = {}
    if f.with_imports:
        extra["imports"] = ctx.tables.imports.join(found.select("path"), "path", "left_semi").select("path", "line", "import_text").orderBy("path", "line")
    if found.isEmpty():
        return not_found(f'No body of "{args[0]}" found', ctx, args[0])
    return Result("bodies", f'Body of "{args[0]}":', {"bodies": found.orderBy("path", "start_line", "end_line"), **extra})


@register("context")
def scopes(ctx: Context, args: list[str]) -> Result:
    path, _, line = args[0].rpartition(":") if args else ("", "", "")
    if not line.isdigit():
        return usage("context <file:line>")
    found = ctx.tables.scopes.where((F.col("path") == path) & F.lit(int(line)).between(F.col("start_line"), F.col("end_line")))
    return Result("scopes", f"Scopes at {args[0]}:", {"scopes": found.orderBy("depth", "start_line").select("name", "kind", F.col("start_line").alias("line"))}, empty=f"No scopes at {args[0]}")


@register("tests")
def tests(ctx: Context, args: list[str]) -> Result:
    f = ctx.flags
    rows = lines.filtered(ctx.tables.tests, F.col("path"), prefix=f.path, exclude=f.exclude_path)
    if args:
        rows = rows.where(F.lower("test_name").contains(args[0].lower()) | F.lower("suite").contains(args[0].lower()))
    if f.count:
        return Result("test_count", "", {"totals": summary.suites(rows)})
    listed = rows.where("test_name is not null")
    if args or f.verbose:
        texts = ctx.tables.texts.select("path", F.split("text", "\n").alias("_t"))
        listed = listed.join(texts, "path").withColumn("body", F.get("_t", F.col("line") - 1)).drop("_t")
    return Result("tests", "Tests:", {"tests": listed.orderBy("path", "suite_line", "line")}, empty="No tests found")


# --- hierarchy ---------------------------------------------------------------------------------------


def _first(ctx: Context, name: str):
    return resolve(replace_flags(ctx, kind=None), name).orderBy(*lookup.definition_order()).first()


def replace_flags(ctx: Context, **changes) -> Context:
    return replace(ctx, flags=replace(ctx.flags, **changes))


@register("hierarchy")
def hierarchy_of(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("hierarchy <symbol>")
    f, root = ctx.flags, _first(ctx, args[0])
    if root is None:
        return not_found(f'No definition of "{args[0]}" found', ctx, args[0])
    depth = max(1, f.depth if f.depth >= 0 else hierarchy.MAX_DEPTH)
    up, down = (f.up or not f.down), (f.down or not f.up)
    edges, symbols_ = _type_graph(ctx), ctx.tables.symbols
    facts = symbols_.where(F.lower("kind").isin(*lookup.TYPE_KINDS)).withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*lookup.definition_order()))).where("_n = 1")
    facts = facts.select(F.lower("name").alias("node"), "name", "kind", F.col("path").alias("file"), "line", "package")
    parts = {}
    for side, wanted in (("parents", up), ("children", down)):
        if wanted:
            tree = hierarchy.walk(edges, root["name"].lower(), depth, down=side == "children")
            parts[side] = tree.join(facts, "node", "left").withColumn("is_external", F.col("name").isNull()).orderBy(F.array_join("path", "\x00"))
            if side == "children":
                parts["truncated"] = hierarchy.truncated(edges, tree, depth)
    return Result("hierarchy", f"Hierarchy of {root['kind']} {root['name']}", parts, {"root": root.asDict()})


@register("overrides")
def overrides(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("overrides <method>")
    t = ctx.tables
    if ctx.flags.of:
        below = lookup.implementations(t.symbols, ctx.flags.of).select("path", F.col("name").alias("owner"))
        rows = t.members.where(F.col("name") == args[0]).join(below.distinct(), ["path", "owner"], "left_semi")
    else:
        below = t.symbols.where(F.size("parents") > 0).select("path", F.col("name").alias("owner"))
        rows = t.members.where((F.col("name") == args[0])).join(below.distinct(), ["path", "owner"], "left_semi")
    if ctx.flags.body:
        rows = _bodies(ctx, rows, ["path", "owner", "name", "line"])
    return Result("overrides", f'Overrides of "{args[0]}":', {"overrides": rows.orderBy("path", "line", "owner")}, empty=f'No overrides of "{args[0]}" found')


@register("deps")
def deps(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("deps <symbol>")
    root = _first(ctx, args[0])
    if root is None:
        return not_found(f'No definition of "{args[0]}" found', ctx, args[0])
    t = ctx.tables
    known = t.symbols.select(F.lower("name").alias("dst")).distinct()

    def hop(front: DataFrame) -> DataFrame:
        """A name depends on what its file imports by name and on the names that its body holds; only names of the index count. Only files and bodies of the front are read."""
        near = front.select(F.col("node").alias("src"))
        owner = t.symbols.select("path", F.lower("name").alias("src")).distinct().join(near, "src", "left_semi")
        by_import = imports.named(t.imports).join(owner, "path").select("src", F.lower("name").alias("dst"), F.lit("import").alias("source"))
        own = t.bodies.select(F.lower("name").alias("src"), "text").join(near, "src", "left_semi").join(owner.select("src"), "src", "left_semi")
        words = own.select("src", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(T.TOKEN), F.lit(0)))).alias("w"))
        by_body = words.select("src", F.lower("w").alias("dst"), F.lit("body").alias("source"))
        return by_import.unionByName(by_body).where("src <> dst").join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.max("source").alias("source"))

    depth = min(max(1, ctx.flags.depth), hierarchy.MAX_DEPTH)
    start = ctx.spark.createDataFrame([(root["name"].lower(),)], "node string")
    found = hierarchy.reach(hop, start, depth).where("depth > 0")
    first = t.symbols.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*lookup.definition_order()))).where("_n = 1")
    rows = found.join(first, F.col("node") == F.lower("name")).join(hop(start).select(F.col("dst").alias("node"), "source"), "node", "left")
    return Result("deps", f'Dependencies of "{args[0]}":', {"deps": rows.select("name", "kind", "path", "line", "package", "depth", "source").orderBy("depth", "name", "path")})


@register("explain")
def explain(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("explain <symbol>")
    f, t, name = ctx.flags, ctx.tables, args[0]
    open_ = replace_flags(ctx, kind=None)
    defs, hint = resolve(open_, name), ""
    if defs.isEmpty():
        near = lookup.search(t.symbols, name).where((F.col("tier") <= 2) | (F.col("tier") == 4) | F.lit(name.lower()).startswith(F.lower("name")))
        near = lookup.kept(open_.kept(near), types_only=True)
        names = [r[0] for r in near.select(F.lower("name")).distinct().limit(2).collect()]
        if len(names) == 1:
            defs, hint = near.drop("tier", "imports"), f'(no exact match for "{name}" — showing {names[0]} instead)'
        elif _package(ctx, name):
            return summary_of(ctx, args)
        else:
            return not_found(f'No definition of "{name}" found', ctx, name)
    order = defs.orderBy(*lookup.definition_order())
    sym = order.first()
    here = (F.col("path") == sym["path"]) & (F.col("owner") == sym["name"]) & (F.col("owner_kind") == sym["kind"].lower())
    own = t.members.where(here)
    limit = 3 if f.brief else f.members_limit
    impls = ctx.kept(lookup.implementations(t.symbols, sym["name"]))
    others = order.select("name", "package").where(~((F.lower("name") == sym["name"].lower()) & (F.col("package") == sym["package"]))).distinct()
    parts = {"symbol": order.limit(1), "others": others, "members": lookup.limited(own.orderBy(*lookup.member_order()), limit), "implementations": lookup.limited(impls.orderBy(*lookup.LAST), f.impl_limit)}
    if not f.no_doc and not f.brief:
        parts["doc"] = t.docs.where((F.col("path") == sym["path"]) & (F.col("line") == sym["line"]))
    if not f.shallow:
        pkgs = ctx.spark.createDataFrame([(sym["package"],)], "package string")
        parts["imports"] = ctx.kept_refs(imports.importers(t.texts, sym["name"], pkgs, t.imports)).orderBy("path", "line")
        partner = lookup.companion(t.symbols, order.limit(1)).select("path", F.col("name").alias("owner"), F.lower("kind").alias("owner_kind"))
        friends = t.members.join(partner, ["path", "owner", "owner_kind"], "left_semi").join(own.select("name", "kind"), ["name", "kind"], "left_anti")
        parts["companion"] = lookup.limited(friends.orderBy(*lookup.member_order()), limit)
    if f.inherited:
        theirs = _inherited(ctx, order.limit(1), sym["name"].lower())
        parts["inherited"] = theirs.join(own.select("name", "kind"), ["name", "kind"], "left_anti").select("name", "kind", F.col("owner").alias("from_owner"))
    if f.expand:
        root = f"{sym['package']}.{sym['name']}".lower()
        tree = lookup.expanded(t.symbols, lookup.limited(impls.orderBy(*lookup.LAST), f.impl_limit), root, f.expand, f.impl_limit, ctx.kept)
        parts["expanded"] = tree.orderBy("place")
        theirs = t.members.join(tree.where("not leaf").select("path", F.col("name").alias("owner"), F.lower("kind").alias("owner_kind")).distinct(), ["path", "owner", "owner_kind"], "left_semi")
        parts["expanded_members"] = lookup.per_group(theirs, ["path", "owner", "owner_line"], lookup.member_order(), limit)
    if f.related:
        words = own.select(F.explode(F.regexp_extract_all("signature", F.lit(TYPE_NAME), F.lit(0))).alias("w")).unionByName(order.limit(1).select(F.explode("parents").alias("w")))
        wanted = words.select(F.lower("w").alias("_w")).where(~F.col("_w").isin(*PREDEF, sym["name"].lower())).distinct()
        own_types = t.symbols.groupBy(F.lower("name").alias("_w")).agg(F.bool_and(F.lower("package").rlike(LIBRARY)).alias("_std")).where("not _std").select("_w")
        first = lookup.kept(t.symbols, types_only=True).withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*lookup.definition_order()))).where("_n = 1")
        met = first.join(wanted.join(own_types, "_w", "left_semi"), F.lower("name") == F.col("_w"), "left_semi")
        parts["related"] = lookup.limited(met.select("name", "kind", "path", "line", "package").orderBy("name", "path", "line"), RELATED)
    return Result("explain", f"Explanation of {sym['kind']} {sym['name']}", parts, {"total_implementations": impls.count()}, hint=hint)


@register("ast-pattern")
def ast_pattern(ctx: Context, args: list[str]) -> Result:
    f, t = ctx.flags, ctx.tables
    rows = lines.filtered(lookup.kept(t.symbols, types_only=True), F.col("path"), f.no_tests, f.path, f.exclude_path)
    if f.extends:
        rows = rows.where(F.exists("parents", lambda p: F.lower(p) == f.extends.lower()))
    if f.has_method:
        rows = rows.join(t.members.where(F.col("name") == f.has_method).select("path", F.col("owner").alias("name")).distinct(), ["path", "name"], "left_semi")
    if f.body_contains:
        has = t.bodies.where(F.col("text").contains(f.body_contains)).select("path", F.col("name"), F.col("start_line").alias("line")).distinct()
        rows = rows.join(has, ["path", "name", "line"], "left_semi")
    return Result("symbols", "Types matching the pattern:", {"symbols": rows.orderBy(*lookup.LAST)}, empty="No types matching AST pattern found")


# --- packages and summaries ---------------------------------------------------------------------------


@register("api")
def api(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("api <package>")
    name = _package(ctx, args[0])
    if name is None:
        return no_package(ctx, args[0])
    surface = imports.api_surface(ctx.tables.symbols, name, ctx.tables.imports, ctx.tables.files, ctx.flags.used_by)
    rows = ctx.kept(surface)
    return Result("api", f"API surface of {name}:", {"exported": rows.where("importer_count > 0").orderBy(F.desc("importer_count"), "name"), "internal": rows.where("importer_count = 0").select("name").orderBy("name")}, {"total": surface.count()})


@register("summary")
def summary_of(ctx: Context, args: list[str]) -> Result:
    if not args:
        return usage("summary <package>")
    name = _package(ctx, args[0])
    if name is None:
        return no_package(ctx, args[0])
    counts = summary.sub_packages(ctx.kept(ctx.tables.symbols), name).orderBy(F.desc("symbol_count"), "sub_package")
    return Result("package_summary", f"Summary of {name}:", {"packages": counts})


@register("overview")
def overview(ctx: Context, args: list[str]) -> Result:
    f = ctx.flags
    ctx = ctx if f.include_tests else replace_flags(ctx, no_tests=True)
    s = ctx.kept(ctx.tables.symbols)
    n = min(f.limit, 10) if f.concise else f.limit
    edges = s.select(F.col("name").alias("child"), "package", F.explode("parents").alias("p")).select("child", "package", F.lower("p").alias("parent"))
    known = ctx.tables.symbols.groupBy(F.lower("name").alias("parent")).agg(F.bool_and(F.lower("package").rlike(LIBRARY)).alias("_std"), F.min_by(F.struct("name", "signature"), F.struct(*lookup.LAST)).alias("is"))
    known = known.where("not _std").select("parent", "is.name", "is.signature")
    edges = edges.where((F.length("parent") > 1) & ~F.col("parent").isin(*COMMON_PARENTS)).join(known, "parent", "left_semi")
    extended = hierarchy.most_extended(edges, n).join(known, "parent").orderBy(F.desc("packages"), F.desc("implementations"), "parent").select("name", "packages", "implementations", "signature")
    parts = {"totals": summary.totals(s), "kinds": summary.count_by(s, "kind"), "packages": summary.count_by(s, "package", n), "most_extended": extended}
    if f.architecture or f.concise or f.focus_package:
        scala_only = ctx.tables.imports.where("lang = 'scala'")
        graph = imports.package_graph(scala_only, ctx.tables.files, f.focus_package)
        parts["dependencies"] = graph.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("deps")).orderBy("src")
        parts["graph_totals"] = summary.api_totals(graph)
        parts["hubs"] = parts.pop("most_extended")
    return Result("overview", "Overview:", parts)


@register("entrypoints")
def entrypoints(ctx: Context, args: list[str]) -> Result:
    found = summary.entrypoints(ctx.kept(ctx.tables.symbols), ctx.tables.members)
    shown = {"MainAnnotation": 0, "MainMethod": 1, "ExtendsApp": 2, "TestSuite": 3}
    some = lookup.per_group(found, ["category"], [F.col("path"), F.col("line")], ctx.flags.limit)
    return Result("entrypoints", "Entrypoints:", {"entrypoints": some.orderBy(T.ranked(F.col("category"), shown), "path", "line")}, empty="No entrypoints found")


@register("diff")
def diff(ctx: Context, args: list[str]) -> Result:
    if not args or ctx.root is None:
        return usage("diff <ref>")
    files = git.changed(ctx.root, args[0])
    if files is None:
        return Result("not_found", f"Could not diff against {args[0]}")
    some = files[: ctx.flags.limit * 5] if ctx.flags.limit else files
    snapshots = _snapshots(ctx.spark.createDataFrame([(p,) for p in some], "path string").repartition(max(1, len(some) // 64 + 1)), ctx.root, args[0])
    old, new = (snapshots.where(F.col("side") == side) for side in ("old", "new"))
    changes = summary.difference(old, new, ["path", "name", "kind"], ["signature", "line"])
    return Result("diff", f"Changes since {args[0]}:", {"changes": changes.orderBy("change", "path", "name", "kind")}, {"files_changed": len(files)})


def _snapshots(paths: DataFrame, root: str, ref: str) -> DataFrame:
    """Symbols of files as they were at ``ref`` and as they are; executors read the work tree, which all of them must see, and parse there."""
    columns = "side string, path string, name string, kind string, line int, package string, signature string"
    schema = to_arrow_schema(StructType.fromDDL(columns))

    def read(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                for side, text in (("old", git.show(root, ref, path)), ("new", _read(root, path))):
                    if text is None:
                        continue
                    lang = git.language(path)
                    src = scan.scan(text, lang)
                    rows += [{"side": side, "path": path, "package": src.package, **{c: d[c] for c in ("name", "kind", "line", "signature")}} for d in scan.symbols(src, lang)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return paths.mapInArrow(read, columns)


def _read(root: str, path: str) -> str | None:
    from pathlib import Path

    try:
        return (Path(root) / path).read_text("utf-8", "replace")
    except OSError:
        return None


def run(ctx: Context, name: str, args: list[str]) -> Result:
    if name not in COMMANDS:
        return usage(f"unknown command {name}; known are {', '.join(sorted(COMMANDS))}")
    return COMMANDS[name](ctx, args)


