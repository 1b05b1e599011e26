"""Streams of source files: incremental refresh of an index, and running counts of references.

An extension beside the batch operators: files dropped into a folder (as Parquet rows path, oid, lang, text) are parsed as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators.lines import lines
from ..sources.ingest import parse

FILES = "path string, oid string, lang string, text string"


def source(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(FILES).parquet(folder)


def refresh(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append index rows of new files to ``out``; each file is parsed once, also over restarts. Runs until all that is there is done."""
    return parse(source(spark, folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(index: DataFrame) -> DataFrame:
    """Of several versions of a path the one that was seen last, by the name of its part file's batch order."""
    from pyspark.sql import Window

    seen = index.withColumn("_at", F.col("_metadata.file_modification_time"))
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_at"), "oid"))
    return seen.withColumn("_n", n).where("_n = 1").drop("_n", "_at")


def running_references(texts: DataFrame, name: str) -> DataFrame:
    """A streaming aggregate: reference lines by category so far. The state holds one row a category."""
    rows = lines(texts).where(T.has_word(F.col("text"), name))
    return rows.groupBy(T.category(F.col("text"), name).alias("category")).agg(F.count("*").alias("count"))


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of (ts, event_type) in tumbling windows; rows later than ``late`` behind the newest are dropped, and state with them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
