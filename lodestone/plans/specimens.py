"""Queries of the scanner over small sources of our own; their SQL lists the facts that a reader of the sources finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import Tables, parse
from .registry import QUERIES, SQL, Query

SOURCES = {
    "src/Store.scala": '''package shop.core

import shop.model.{Item, Order as Purchase}
import scala.util._

/** Keeps items.
  * For all. */
trait Store[T] extends Base[Item] with Closeable {
  import shop.util.Clock
  def find(id: Int): Option[T]
  val size: Int
}

@deprecated("old") @tag
class MemoryStore(val name: String, limit: Int) extends Store[Item] {
  type Key = Int
  var hits = 0
  override def find(id: Int): Option[Item] = {
    def local(x: Int) = x + 1
    hits += local(id)
    None
  }
}

object MemoryStore {
  def apply(): MemoryStore = new MemoryStore("m", 3)
}
''',
    "src/Shapes.scala": '''package shop.shapes

enum Color(val rgb: Int):
  case Red extends Color(1)
  case Green extends Color(2)

/** A shape. */
sealed trait Shape:
  def area: Double

case class Square(side: Double) extends Shape:
  def area = side * side

given Ordering[Square] = Ordering.by(_.side)

type Name = String

extension (s: Shape)
  def twice: Double = s.area * 2

@main def draw(): Unit = ()
''',
    "src/test/StoreSuite.scala": '''package shop.core

class StoreSuite extends munit.FunSuite {
  test("finds nothing") {
    assert(true)
  }
  for (i <- 1 to 2) test(s"case $i") { }
}
''',
    "src/Repo.java": '''package shop.db;

import java.util.List;
import static java.util.Map.entry;

@Entity
public class Repo<T> extends Base<T> implements Closeable, Sized {
  private final int size = 3;
  String label;
  public Repo(int size) { this.size = size; }
  @Override
  public List<T> all(String q) {
    return null;
  }
  interface Sized { int size(); }
  enum Mode { READ, WRITE }
}
''',
    "src/Broken.scala": "package shop\nclass Broken {\n  def f( = 1\n",
}


def _tables(spark) -> Tables:
    rows = [(path, str(i), path.rpartition(".")[2], text) for i, (path, text) in enumerate(SOURCES.items())]
    return Tables(parse(spark.createDataFrame(rows, "path string, oid string, lang string, text string")))


def specimen(columns: str, *rows: str):
    """Registers a query with the facts as rows of SQL values."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) facts({columns})"
        return f

    return add


@specimen(
    "path, name, kind, line, package, parents, targs, signature, annotations",
    "'src/Store.scala', 'Store', 'trait', 8, 'shop.core', 'Base,Closeable', 'Item', 'trait Store[T] extends Base with Closeable', ''",
    "'src/Store.scala', 'MemoryStore', 'class', 14, 'shop.core', 'Store', 'Item', 'class MemoryStore extends Store', 'deprecated,tag'",
    "'src/Store.scala', 'Key', 'type', 16, 'shop.core', '', '', 'type Key = Int', ''",
    "'src/Store.scala', 'find', 'def', 18, 'shop.core', '', '', 'def find(id: Int): Option[Item]', ''",
    "'src/Store.scala', 'MemoryStore', 'object', 25, 'shop.core', '', '', 'object MemoryStore', ''",
    "'src/Store.scala', 'apply', 'def', 26, 'shop.core', '', '', 'def apply(): MemoryStore', ''",
    "'src/Shapes.scala', 'Color', 'enum', 3, 'shop.shapes', '', '', 'enum Color', ''",
    "'src/Shapes.scala', 'Shape', 'trait', 8, 'shop.shapes', '', '', 'trait Shape', ''",
    "'src/Shapes.scala', 'Square', 'class', 11, 'shop.shapes', 'Shape', '', 'class Square extends Shape', ''",
    "'src/Shapes.scala', 'area', 'def', 12, 'shop.shapes', '', '', 'def area: ?', ''",
    "'src/Shapes.scala', 'Ordering', 'given', 14, 'shop.shapes', '', '', 'given Ordering', ''",
    "'src/Shapes.scala', 'Name', 'type', 16, 'shop.shapes', '', '', 'type Name = String', ''",
    "'src/Shapes.scala', '<extension>', 'extension', 18, 'shop.shapes', '', '', 'extension (s: Shape)', ''",
    "'src/Shapes.scala', 'twice', 'def', 19, 'shop.shapes', '', '', 'def twice: Double', ''",
    "'src/Shapes.scala', 'draw', 'def', 21, 'shop.shapes', '', '', 'def draw(): Unit', 'main'",
    "'src/test/StoreSuite.scala', 'StoreSuite', 'class', 3, 'shop.core', 'FunSuite', '', 'class StoreSuite extends FunSuite', ''",
    "'src/Repo.java', 'Repo', 'class', 6, 'shop.db', 'Base,Closeable,Sized', '', 'class Repo<T> extends Base, Closeable, Sized', 'Entity'",
    "'src/Repo.java', 'size', 'val', 8, 'shop.db', '', '', 'val size: int', ''",
    "'src/Repo.java', 'label', 'var', 9, 'shop.db', '', '', 'var label: String', ''",
    "'src/Repo.java', 'all', 'def', 11, 'shop.db', '', '', 'def all(String q): List<T>', 'Override'",
    "'src/Repo.java', 'Sized', 'trait', 15, 'shop.db', '', '', 'interface Sized', ''",
    "'src/Repo.java', 'size', 'def', 15, 'shop.db', '', '', 'def size(): int', ''",
    "'src/Repo.java', 'Mode', 'enum', 16, 'shop.db', '', '', 'enum Mode', ''",
)
def scan_symbols(spark, sf) -> DataFrame:
    """Definitions with parents, type arguments of parents, signatures and annotations; declarations without a body are members alone."""
    s = _tables(spark).symbols
    return s.select("path", "name", "kind", "line", "package", F.array_join("parents", ",").alias("parents"), F.array_join("type_param_parents", ",").alias("targs"), "signature", F.array_join("annotations", ",").alias("annotations"))


@specimen(
    "owner, owner_kind, ord, name, kind, line, end_line, signature, is_override",
    "'Store', 'trait', 0, 'find', 'def', 10, 10, 'def find(id: Int): Option[T]', FALSE",
    "'Store', 'trait', 1, 'size', 'val', 11, 11, 'val size: Int', FALSE",
    "'MemoryStore', 'class', 0, 'name', 'val', 14, 14, 'val name: String', FALSE",
    "'MemoryStore', 'class', 1, 'Key', 'type', 16, 16, 'type Key = Int', FALSE",
    "'MemoryStore', 'class', 2, 'hits', 'var', 17, 17, 'var hits: ?', FALSE",
    "'MemoryStore', 'class', 3, 'find', 'def', 18, 22, 'def find(id: Int): Option[Item]', TRUE",
    "'MemoryStore', 'object', 0, 'apply', 'def', 26, 26, 'def apply(): MemoryStore', FALSE",
    "'Color', 'enum', 0, 'rgb', 'val', 3, 3, 'val rgb: Int', FALSE",
    "'Shape', 'trait', 0, 'area', 'def', 9, 9, 'def area: Double', FALSE",
    "'Square', 'class', 0, 'side', 'val', 11, 11, 'val side: Double', FALSE",
    "'Square', 'class', 1, 'area', 'def', 12, 12, 'def area: ?', FALSE",
    "'Repo', 'class', 0, 'size', 'val', 8, 8, 'val size: int', FALSE",
    "'Repo', 'class', 1, 'label', 'var', 9, 9, 'var label: String', FALSE",
    "'Repo', 'class', 2, '<init>', 'def', 10, 10, 'Repo(int size)', FALSE",
    "'Repo', 'class', 3, 'all', 'def', 11, 14, 'def all(String q): List<T>', TRUE",
    "'Repo', 'class', 4, 'Sized', 'trait', 15, 15, 'interface Sized', FALSE",
    "'Repo', 'class', 5, 'Mode', 'enum', 16, 16, 'enum Mode', FALSE",
    "'Sized', 'trait', 0, 'size', 'def', 15, 15, 'def size(): int', FALSE",
    "'Mode', 'enum', 0, 'READ', 'val', 16, 16, 'READ', FALSE",
    "'Mode', 'enum', 1, 'WRITE', 'val', 16, 16, 'WRITE', FALSE",
)
def scan_members(spark, sf) -> DataFrame:
    """Members in the order of the source; parameters of classes count where they are values, those of case classes always."""
    return _tables(spark).members.select("owner", "owner_kind", "ord", "name", "kind", "line", "end_line", "signature", "is_override")


@specimen(
    "owner, name, start_line, end_line, is_abstract, n_chars",
    "'', 'Store', 8, 12, FALSE, 124",
    "'Store', 'find', 10, 10, TRUE, 30",
    "'Store', 'size', 11, 11, TRUE, 15",
    "'MemoryStore', 'find', 18, 22, FALSE, 111",
    "'MemoryStore', 'local', 19, 19, FALSE, 29",
    "'MemoryStore', 'apply', 26, 26, FALSE, 52",
    "'Shape', 'area', 9, 9, TRUE, 18",
    "'Square', 'area', 12, 12, FALSE, 24",
    "'', 'twice', 19, 19, FALSE, 32",
    "'', 'draw', 21, 21, FALSE, 27",
    "'Repo', 'all', 11, 14, FALSE, 65",
    "'Sized', 'size', 15, 15, TRUE, 33",
)
def scan_bodies(spark, sf) -> DataFrame:
    """Bodies of methods, local ones too, and of abstract members; whole source lines."""
    b = _tables(spark).bodies.where("kind in ('def', 'trait') and name not in ('Shape', 'Sized') or name = 'size' and is_abstract")
    return b.select("owner", "name", "start_line", "end_line", "is_abstract", F.length("text").alias("n_chars"))


@specimen(
    "name, kind, start_line, end_line, depth",
    "'shop.core', 'package', 1, 28, 0",
    "'Store', 'trait', 8, 12, 0",
    "'find', 'def', 10, 10, 1",
    "'size', 'val', 11, 11, 1",
    "'MemoryStore', 'class', 14, 23, 0",
    "'find', 'def', 18, 22, 1",
    "'local', 'def', 19, 19, 2",
    "'MemoryStore', 'object', 25, 27, 0",
    "'apply', 'def', 26, 26, 1",
)
def scan_scopes(spark, sf) -> DataFrame:
    """Scopes of one file, from outside to inside."""
    return _tables(spark).scopes.where("path = 'src/Store.scala'").select("name", "kind", "start_line", "end_line", "depth")


@specimen("suite, suite_line, test_name, line, is_dynamic", "'StoreSuite', 3, 'finds nothing', 4, FALSE", "'StoreSuite', 3, NULL, 7, TRUE")
def scan_tests(spark, sf) -> DataFrame:
    """Tests with a literal name, and sites whose name is computed."""
    return _tables(spark).tests.select("suite", "suite_line", "test_name", "line", "is_dynamic")


@specimen("path, line, doc", "'src/Store.scala', 8, '/** Keeps items.' || chr(10) || '  * For all. */'", "'src/Shapes.scala', 8, '/** A shape. */'")
def scan_docs(spark, sf) -> DataFrame:
    return _tables(spark).docs


@specimen(
    "path, line, import_text, pkg, names, is_wildcard",
    "'src/Store.scala', 3, 'import shop.model.{Item, Order as Purchase}', 'shop.model', 'Item,Order', FALSE",
    "'src/Store.scala', 4, 'import scala.util._', 'scala.util', '', TRUE",
    "'src/Store.scala', 9, 'import shop.util.Clock', 'shop.util', 'Clock', FALSE",
    "'src/Repo.java', 3, 'import java.util.List', 'java.util', 'List', FALSE",
    "'src/Repo.java', 4, 'import java.util.Map.entry', 'java.util.Map', 'entry', FALSE",
)
def scan_imports(spark, sf) -> DataFrame:
    """Imports at any depth."""
    return _tables(spark).imports.select("path", "line", "import_text", "pkg", F.array_join("names", ",").alias("names"), "is_wildcard")


@specimen("path, original, alias", "'src/Store.scala', 'Order', 'Purchase'")
def scan_aliases(spark, sf) -> DataFrame:
    return _tables(spark).aliases


@specimen(
    "path, lang, package, is_test, parse_failed",
    "'src/Store.scala', 'scala', 'shop.core', FALSE, FALSE",
    "'src/Shapes.scala', 'scala', 'shop.shapes', FALSE, FALSE",
    "'src/test/StoreSuite.scala', 'scala', 'shop.core', TRUE, FALSE",
    "'src/Repo.java', 'java', 'shop.db', FALSE, FALSE",
    "'src/Broken.scala', 'scala', '', FALSE, TRUE",
)
def scan_files(spark, sf) -> DataFrame:
    """One file has brackets that don't match."""
    return _tables(spark).files.select("path", "lang", "package", "is_test", "parse_failed")
