import json
import subprocess

import pytest
from lodestone.plans import cli
from lodestone.plans.commands import Context, Flags, run
from lodestone.sources import git, scan
from lodestone.sources.ingest import IndexStore, Tables, index_work_tree
from pyspark.sql import functions as F

FILES = {
    "src/main/Service.scala": """package com.acme

import com.acme.model.{Item, Order as Purchase}

/** Serves items. */
trait Service {
  def find(id: Int): Option[Item]
}

class DefaultService extends Service {
  override def find(id: Int): Option[Item] = {
    def helper(x: Int) = x + 1
    None
  }
  def total(p: Purchase): Int = p.amount
}

object DefaultService {
  def apply(): DefaultService = new DefaultService
}
""",
    "src/main/Model.scala": """package com.acme.model

@deprecated("old")
case class Item(id: Int, name: String)
case class Order(amount: Int)

enum Color:
  case Red, Green

type Id = Int
""",
    "src/main/Wild.scala": """package com.other

import com.acme._

class Wild extends Service with Runner[Map[String, Widget]]:
  def find(id: Int) = None
  val s: Service = this
""",
    "src/main/Far.scala": """package com.far
class Far:
  // Service is only named here
  val x = "Service"
""",
    "src/main/Main.scala": """package com.acme
object Main {
  def main(args: Array[String]): Unit = println(1)
}
@main def hello(): Unit = ()
object Old extends App
""",
    "src/test/ServiceTest.scala": """package com.acme
class ServiceTest extends munit.FunSuite {
  test("finds items") {
    assert(new DefaultService().find(1).isEmpty)
  }
  for (i <- 1 to 2) test(s"case $i") { }
}
""",
    "src/main/Repo.java": """package com.acme.store;
import java.util.List;
import com.acme.model.*;
@Entity
public class Repo<T> extends Base<Item> implements Closeable {
  private final int size = 3;
  public Repo(int size) { }
  @Override public List<T> all(String q) { return null; }
  enum Mode { READ, WRITE; }
}
""",
    "src/main/Broken.scala": "package com.acme\nclass Broken {\n  def f( = 1\n",
    "README.md": "Service",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    for args in (["init", "-q"], ["config", "user.email", "a@b"], ["config", "user.name", "a"], ["add", "-A"], ["commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(root), *args], check=True)
    return str(root)


@pytest.fixture(scope="module")
def ctx(spark, repo, tmp_path_factory):
    index, stats = index_work_tree(spark, repo, str(tmp_path_factory.mktemp("store")))
    return Context(Tables(index.persist()), root=repo, stats=stats)


def ask(ctx, line):
    return cli.answer(ctx, line.split(" "))


def names(ctx, line):
    return [r["name"] for r in json.loads(ask(ctx, line + " --json"))]


def test_listing(repo):
    assert [p for p, _, _ in git.listing(repo)] == sorted(p for p in FILES if p != "README.md")
    assert git.listing(repo) == git.listing(repo, staged=True)


def test_incremental(spark, repo, tmp_path):
    store = str(tmp_path / "store")
    _, s = index_work_tree(spark, repo, store)
    assert (s.parsed_count, s.skipped_count, s.cached_load) == (8, 0, False)
    old, s = index_work_tree(spark, repo, store)
    assert (s.parsed_count, s.skipped_count, s.cached_load) == (0, 8, True)
    path = f"{repo}/src/main/Far.scala"
    before = FILES["src/main/Far.scala"]
    with open(path, "w") as f:
        f.write(before.replace("class Far", "class Farther"))
    new, s = index_work_tree(spark, repo, store)
    with open(path, "w") as f:
        f.write(before)
    assert (s.parsed_count, s.skipped_count) == (1, 7)
    assert {r[0] for r in Tables(new).symbols.select("name").collect()} >= {"Farther", "Service"}
    assert "Far" in {r[0] for r in Tables(old).symbols.select("name").collect()}


def test_refresh_reads_and_writes_one_file(spark, repo, tmp_path):
    """Only the edited file is read and written; a removed one leaves no row; many refreshes are merged to one folder."""
    store = IndexStore(spark, str(tmp_path / "store"))
    asked = []

    def files(version):
        return spark.createDataFrame([(f"f{i}.scala", f"o{i}" if i else f"v{version}", "scala") for i in range(4)], git.FILES)

    def read(todo):
        asked.append(sorted(r.path for r in todo.collect()))
        return todo.withColumn("text", F.concat(F.lit("class "), F.upper(F.substring("oid", 1, 2))))

    store.refresh(files(0), read)
    for v in range(1, 4):
        index, stats = store.refresh(files(v), read)
        assert (stats.parsed_count, asked[-1]) == (1, ["f0.scala"])
        assert sorted(r.name for r in Tables(index).symbols.select("name").collect()) == ["O1", "O2", "O3", f"V{v}"]
        newest = spark.read.parquet(f"{store.root}/{store.current()['rows'][-1]}")
        assert [r.path for r in newest.select("path").collect()] == ["f0.scala"]
    index, stats = store.refresh(files(3).where("path <> 'f2.scala'"), read)
    assert stats.parsed_count == 0 and index.count() == 3 and len(asked) == 4
    store.MERGE = 1
    index, _ = store.refresh(files(5).where("path <> 'f2.scala'"), read)
    assert len(store.current()["rows"]) == 1 and index.count() == 3


def test_def_and_ranking(ctx):
    assert names(ctx, "def DefaultService") == ["DefaultService", "DefaultService"]
    assert names(ctx, "def com.acme.model.Item") == ["Item"]
    assert names(ctx, "def model.Item") == ["Item"]
    assert names(ctx, "def DefaultService.total") == ["total"]
    assert "Did you mean" in ask(ctx, "def Servic")


def test_search(ctx):
    assert names(ctx, "search service")[0] == "Service"
    assert "DefaultService" in names(ctx, "search DefSer")
    assert names(ctx, "search Service --exact") == ["Service"]
    assert set(names(ctx, "search i --kind def --returns item")) <= {"find"}


def test_impl(ctx):
    assert names(ctx, "impl Service") == ["DefaultService", "Wild"]
    assert names(ctx, "impl Widget") == ["Wild"]
    assert names(ctx, "impl Base") == ["Repo"]


def test_refs(ctx):
    rows = json.loads(ask(ctx, "refs Service --flat --json"))["results"]
    level = {(r["file"].split("/")[-1], r["line"]): r["confidence"] for r in rows}
    assert level[("Service.scala", 6)] == "High" and level[("Wild.scala", 5)] == "Medium" and level[("Far.scala", 3)] == "Low"
    kinds = json.loads(ask(ctx, "refs Service --count --json"))
    assert {r["category"] for r in kinds} >= {"Definition", "ExtendedBy", "Comment", "UsedAsType"}
    assert json.loads(ask(ctx, "refs Service --top 1 --json"))[0] == {"file": "src/main/Far.scala", "count": 2}
    alias = [r for r in json.loads(ask(ctx, "refs Order --flat --json"))["results"] if r["alias"]]
    assert [r["alias"] for r in alias] == ["Purchase"]


def test_imports(ctx):
    rows = json.loads(ask(ctx, "imports Item --json"))["results"]
    assert {r["file"].split("/")[-1] for r in rows} == {"Service.scala", "Repo.java"}


def test_members(ctx):
    rows = json.loads(ask(ctx, "members DefaultService --body --json"))
    assert [r["name"] for r in rows if r["ownerKind"] == "class"] == ["find", "total"]
    assert "def helper" in rows[0]["body"]
    assert [r["name"] for r in json.loads(ask(ctx, "members Item --json"))] == ["id", "name"]
    assert {r["name"] for r in json.loads(ask(ctx, "members Repo --json"))} == {"size", "<init>", "all", "Mode"}
    assert any(r.get("isOverride") for r in json.loads(ask(ctx, "members Wild --inherited --json")))


def test_body_doc_scopes(ctx):
    assert "def helper" in ask(ctx, "body helper")
    assert "/** Serves items. */" in ask(ctx, "doc Service")
    scopes = json.loads(ask(ctx, "context src/main/Service.scala:12 --json"))
    assert [s["name"] for s in scopes] == ["com.acme", "DefaultService", "find", "helper"]


def test_hierarchy_overrides_deps(ctx):
    tree = json.loads(ask(ctx, "hierarchy Service --json"))
    assert sorted(c["node"]["name"] for c in tree["children"]) == ["DefaultService", "Wild"]
    up = json.loads(ask(ctx, "hierarchy Wild --up --json"))["parents"]
    assert {p["node"]["name"].lower(): p["node"]["isExternal"] for p in up} == {"service": False, "runner": True}
    assert "Wild" in ask(ctx, "overrides find --of Service")
    assert "Item" in ask(ctx, "deps DefaultService")


def test_packages_and_summaries(ctx):
    assert json.loads(ask(ctx, "packages --json")) == ["com.acme", "com.acme.model", "com.acme.store", "com.far", "com.other"]
    assert "Item" in ask(ctx, "package model")
    api = json.loads(ask(ctx, "api com.acme.model --json"))
    assert {r["name"]: r["importer_count"] for r in api["exported"]}["Item"] == 2
    assert "model" in ask(ctx, "summary com.acme")
    assert "com.acme" in ask(ctx, "overview --architecture")
    assert "implCount" in ask(ctx, "package com.acme --explain --json") or "impl_count" in ask(ctx, "package com.acme --explain --json")


def test_entrypoints_tests_coverage(ctx):
    rows = json.loads(ask(ctx, "entrypoints --json"))["entrypoints"]
    assert [(r["name"], r["category"]) for r in rows] == [("hello", "MainAnnotation"), ("Main", "MainMethod"), ("Old", "ExtendsApp"), ("ServiceTest", "TestSuite")]
    assert json.loads(ask(ctx, "tests --count --json"))["totals"][0] == {"suites": 1, "tests": 1, "dynamic_sites": 1}
    assert "finds items" in ask(ctx, "tests finds")
    assert json.loads(ask(ctx, "coverage DefaultService --json"))["testFileCount"] == 1


def test_grep(ctx):
    assert json.loads(ask(ctx, "grep def\\s+find --count --json")) == {"matches": 3, "files": 2, "timedOut": False}
    assert "helper" in ask(ctx, "grep x --in DefaultService --each-method") or "find" in ask(ctx, "grep x --in DefaultService --each-method")


def test_explain_and_ast_pattern(ctx):
    text = ask(ctx, "explain Service")
    assert "DefaultService" in text and "Serves items" in text
    assert "instead" in ask(ctx, "explain Defaultservic")
    assert names(ctx, "ast-pattern --extends Service --has-method total") == ["DefaultService"]
    assert names(ctx, "ast-pattern --body-contains helper") == ["DefaultService"]


def test_annotated_symbols_file_index(ctx):
    assert names(ctx, "annotated @deprecated") == ["Item"]
    assert names(ctx, "symbols src/main/Model.scala")[:2] == ["Item", "Order"]
    assert json.loads(ask(ctx, "file serv --json"))[0] == "src/main/Service.scala"
    stats = json.loads(ask(ctx, "index --json"))
    assert stats["fileCount"] == 8 and stats["parseFailures"] == 1


def test_diff(ctx, repo):
    path = f"{repo}/src/main/Model.scala"
    with open(path, "w") as f:
        f.write(FILES["src/main/Model.scala"].replace("case class Order(amount: Int)", "case class Order(amount: Int) extends Base\nclass New"))
    rows = {r.name: r.change for r in run(ctx, "diff", ["HEAD"]).parts["changes"].collect()}
    with open(path, "w") as f:
        f.write(FILES["src/main/Model.scala"])
    assert rows["New"] == "added" and rows["Order"] == "modified"


def test_batch_and_budget(ctx):
    out = cli.batch(Context(ctx.tables, Flags(max_output=60), ctx.root), ["def Service", "graph --render A->B", "nonsense", "refs 'Service' --count"])
    assert len(out) == 4 and "unknown command" in out[2] and all(len(t) < 160 for t in out)


def test_scanner_cards():
    s = scan.scala("package p\nobject O:\n  def f(a: Int = 1): Int =\n    a\n  abstract class C(val x: Int):\n    def g: Int\nimport a.B, c.D\n")
    assert [(d["name"], d["kind"], d["line"]) for d in scan.symbols(s, "scala")] == [("O", "object", 2), ("f", "def", 3), ("C", "class", 5)]
    assert [t for _, t in s.imports] == ["import a.B", "import c.D"]
    assert [(m["owner"], m["name"]) for m in scan.members(s, "scala")] == [("O", "f"), ("O", "C"), ("C", "x"), ("C", "g")]
    assert scan.scala('val s = "a { b" /* } */ // }\n').failed is False
