"""Session helpers: a factory for local use and code shipping for clusters."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on ``local[cpus]``; on a cluster, pass your own session to the operators instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Deals out anew the rows of a source that has fewer files than there are cores, as one file may be one task; other sources stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors.

    Nothing is done where ``PYTHONPATH`` already has it; else a zip of the package goes out with
    ``addPyFile``, once per application.
    """
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    mark = "spark.lodestone.shipped"
    if sc.getLocalProperty(mark):
        return
    path = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc.setLocalProperty(mark, "1")
