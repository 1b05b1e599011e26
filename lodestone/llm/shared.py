"""Intermediate tables and files in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset (tests, a laptop) a local
folder is used. Tables are written by Spark's committers, so a lost executor costs a task, not the table.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "file:///tmp/lodestone-shared"
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or DEFAULT_DIR).rstrip("/")


def small_batches(spark: SparkSession, records: int = 2_000) -> SparkSession:
    """Rows that go to Python at once, for tables of whole texts; a value that the user has set to less stays.

    Spark's default of 10,000 texts takes tens of megabytes in the JVM and in the worker, for each task that runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > records:
        spark.conf.set(key, records)
    return spark


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column of ``taken`` is called so, in whatever case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def plain_names(names: list[str]) -> list[str]:
    """The same names, but new ones for those that ``mapInArrow`` can't take (with dots, backticks and the like)."""
    out: list[str] = []
    for i, name in enumerate(names):
        out.append(name if re.fullmatch(r"\w+", name) else free_name([*names, *out], f"column_{i}"))
    return out


_scratch: list[list[str]] = []


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there.

    Inside ``scratch`` the table lives to the end of it; one that is to be kept, to the end of the scratch around that, if there is one.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables made inside are removed at its end, and the driver lets go of what it holds of them, so that Spark
    deletes the shuffle files of finished steps now and not at some later collection of garbage.

    What is returned from inside must be kept, as it cannot be computed afterwards.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or table, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session has ended before us
            return


# --- raw files ------------------------------------------------------------------------------------


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, parts) -> int:
    """Write byte strings to one file under a temporary name, then rename it; returns the size."""
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as out:
        for p in parts:
            out.write(p)
            size += len(p)
    store.move(tmp, path)
    return size


def read_range(uri: str, start: int, size: int) -> bytes:
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def map_file(uri: str) -> pa.Buffer:
    """The file as a buffer: memory-mapped where the path is local or mounted, else read whole."""
    store, path = _at(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()
