"""From sources to the tables of a code index, and the index on disk.

Parsing is one map over files (path, oid, lang, text): a row of nested facts each. The index is that table as Parquet, in folders that are only added
to and a pointer to those in use; a refresh reads, parses and writes only files whose (path, oid) is new. Tables
(``symbols``, ``members``, …) are projections that read only their own columns.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from . import git, scan

SYMBOL = "name:string,kind:string,line:int,parents:array<string>,type_param_parents:array<string>,signature:string,annotations:array<string>"
MEMBER = "owner:string,owner_kind:string,owner_line:int,ord:int,name:string,kind:string,line:int,end_line:int,signature:string,annotations:array<string>,is_override:boolean"
BODY = "owner:string,name:string,kind:string,start_line:int,end_line:int,is_abstract:boolean,text:string"
SCOPE = "name:string,kind:string,start_line:int,end_line:int,depth:int"
TEST = "suite:string,suite_line:int,test_name:string,line:int,is_dynamic:boolean"
DOC = "line:int,doc:string"
IMPORT = "line:int,import_text:string"
INDEX = (
    f"path string, oid string, lang string, text string, package string, parse_failed boolean, symbols array<struct<{SYMBOL}>>, members array<struct<{MEMBER}>>, "
    f"bodies array<struct<{BODY}>>, scopes array<struct<{SCOPE}>>, tests array<struct<{TEST}>>, docs array<struct<{DOC}>>, imports array<struct<{IMPORT}>>"
)
NESTED = ("symbols", "members", "bodies", "scopes", "tests", "docs", "imports")


def facts(path: str, oid: str, lang: str, text: str) -> dict:
    """One index row."""
    s = scan.scan(text, lang)
    found = scan.symbols(s, lang)
    return {
        "path": path, "oid": oid, "lang": lang, "text": text, "package": s.package if found else "", "parse_failed": s.failed, "symbols": found, "members": scan.members(s, lang), "bodies": scan.bodies(s, text),
        "scopes": scan.scopes(s, text.count("\n") + 1), "tests": scan.tests(s, text), "docs": scan.docs(s, text) if lang == "scala" else [], "imports": [{"line": n, "import_text": t} for n, t in s.imports],
    }


def parse(files: DataFrame) -> DataFrame:
    """Index rows of ``files`` (path, oid, lang, text). A source that cannot be parsed keeps its text and is flagged."""
    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # rows of large nested values: few at a time
                yield pa.RecordBatch.from_pylist([facts(r["path"], r["oid"], r["lang"], r["text"] or "") for r in batch.slice(i, 64).to_pylist()], schema=schema)

    return files.select("path", "oid", "lang", "text").mapInArrow(run, INDEX)


#: Up to so many files are read by name; more by a listing of the whole tree.
BY_NAME = 10_000


def read_sources(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Adds the texts of ``files`` below ``root``, a folder that all executors see; unreadable files are left out. No other file is read."""
    names = [r[0] for r in files.select("path").limit(BY_NAME + 1).collect()]
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/"))
    read = spark.read.format("binaryFile")
    if len(names) <= BY_NAME:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        store = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [p for p in (f"{root.rstrip('/')}/{n}" for n in names) if store.exists(hadoop.Path(p))]
        if not there:
            return files.limit(0).withColumn("text", F.lit(""))
        # Names with characters that stand for patterns, or commas, are escaped, as Spark takes each path for a pattern.
        found = read.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in there])
    else:
        found = read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{scala,java}").load(root)
    place = F.regexp_replace("path", "^[a-z]+:/+", "/")
    own = found.where(place.startswith(f"{base}/")).select(F.substring(place, len(base) + 2, 1 << 20).alias("path"), "content")
    return files.join(own, "path").select(*files.columns, F.decode("content", "UTF-8").alias("text"))


@dataclass
class Stats:
    file_count: int
    parsed_count: int
    skipped_count: int
    cached_load: bool


class IndexStore:
    """An index as folders of rows that are only ever added to, and the pointer file ``root/CURRENT``, all through Spark's own file systems.

    The pointer names the folders of rows in use and a small table of the (path, oid) that are live. A refresh adds one folder with the rows of new and edited files and a new
    table of live ones; rows of other files are neither read nor written. After ``MERGE`` folders all live rows move to one, and folders that neither the
    pointer nor the one before it names are removed, so readers of the index before are not disturbed.
    """

    MERGE = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """{"rows": folders, "live": folder, "before": folders of the index before}."""
        path, fs = self._fs()
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT").first()[0]) if fs.exists(path) else None

    def _point(self, now: dict) -> None:
        path, fs = self._fs()
        fs.mkdirs(path.getParent())
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def live(self, now: dict) -> DataFrame:
        return self.spark.read.schema("path string, oid string").parquet(f"{self.root}/{now['live']}")

    def load(self) -> DataFrame | None:
        now = self.current()
        if now is None:
            return None
        rows = self.spark.read.schema(INDEX).parquet(*(f"{self.root}/{n}" for n in now["rows"]))
        return rows if len(now["rows"]) == 1 and now.get("whole") else rows.join(self.live(now), ["path", "oid"], "left_semi")

    def save(self, rows: DataFrame) -> DataFrame:
        """All rows anew, in one folder."""
        old = self.current()
        name = self._write(rows, "v")
        live = self._write(self.spark.read.schema(INDEX).parquet(f"{self.root}/{name}").select("path", "oid"), "live")
        before = [*old["rows"], old["live"]] if old else []
        self._point({"rows": [name], "live": live, "whole": True, "before": before})
        if old:
            path, fs = self._fs()
            keep = {name, live, *before, "CURRENT"}
            for f in fs.listStatus(path.getParent()):
                if f.getPath().getName() not in keep:
                    fs.delete(f.getPath(), True)
        return self.load()

    def refresh(self, files: DataFrame, read) -> tuple[DataFrame, Stats]:
        """Bring the index to ``files`` (path, oid, lang). ``read`` adds texts to the files that must be parsed."""
        now, total = self.current(), files.count()
        if now is None:
            return self.save(parse(read(files))), Stats(total, total, 0, False)
        known = self.live(now)
        todo = files.join(known, ["path", "oid"], "left_anti")
        n = todo.count()
        if n == 0 and known.count() == total:
            return self.load(), Stats(total, 0, total, True)  # nothing is written
        new = self._write(parse(read(todo)), "d") if n else None
        rows = [*now["rows"], *([new] if new else [])]
        added = self.spark.read.schema(INDEX).parquet(f"{self.root}/{new}").select("path", "oid") if new else known.limit(0)
        live = self._write(known.join(files.select("path", "oid"), ["path", "oid"], "left_semi").unionByName(added).distinct(), "live")
        self._point({"rows": rows, "live": live, "whole": False, "before": [*now["rows"], now["live"]]})
        index = self.save(self.load()) if len(rows) > self.MERGE else self.load()
        return index, Stats(total, n, total - n, True)


def index_work_tree(spark: SparkSession, root: str, store: str, staged: bool = False) -> tuple[DataFrame, Stats]:
    """Index a git work tree incrementally."""
    return IndexStore(spark, store).refresh(git.ls_files(spark, root, staged), lambda files: read_sources(spark, root, files))


# --- tables --------------------------------------------------------------------------------------------


class Tables:
    """Tables of an index frame; each reads its own columns only."""

    def __init__(self, index: DataFrame):
        self.index = index

    def _table(self, name: str, *extra: str) -> DataFrame:
        return self.index.select("path", *extra, F.inline(name))

    @property
    def files(self) -> DataFrame:
        return self.index.select("path", "oid", "lang", "package", T.is_test_path(F.col("path")).alias("is_test"), "parse_failed")

    @property
    def texts(self) -> DataFrame:
        return self.index.select("path", "text")

    @property
    def symbols(self) -> DataFrame:
        return self._table("symbols", "package")

    @property
    def members(self) -> DataFrame:
        return self._table("members", "package")

    @property
    def bodies(self) -> DataFrame:
        return self._table("bodies", "package")

    @property
    def scopes(self) -> DataFrame:
        return self._table("scopes")

    @property
    def tests(self) -> DataFrame:
        return self._table("tests")

    @property
    def docs(self) -> DataFrame:
        return self._table("docs")

    @property
    def imports(self) -> DataFrame:
        from ..operators import imports

        return imports.parsed(self._table("imports", "lang"))

    @property
    def aliases(self) -> DataFrame:
        return self._table("imports").select("path", F.explode(T.import_aliases(F.col("import_text"))).alias("original", "alias"))
