import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])  # for the workers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows_of(columns, rows):
    """Rows as sorted tuples in the order of the column names, floats rounded."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and v != v else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the smallest tables; gives both results."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def run(query, sql):
        df = query(spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        return rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())

    return run
