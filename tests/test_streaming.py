from lodestone.sources.ingest import INDEX, Tables
from lodestone.streaming import refresh as R


def test_files_dropped_into_a_folder(spark, tmp_path):
    drop, out, cp = (str(tmp_path / x) for x in ("drop", "out", "cp"))
    put = lambda rows: spark.createDataFrame(rows, R.FILES).write.mode("append").parquet(drop)
    put([("A.scala", "1", "scala", "class A")])
    R.refresh(spark, drop, out, cp).awaitTermination()
    put([("B.scala", "2", "scala", "class B extends A")])
    R.refresh(spark, drop, out, cp).awaitTermination()
    got = Tables(R.latest(spark.read.schema(INDEX).parquet(out))).symbols
    assert sorted(r.name for r in got.collect()) == ["A", "B"]


def test_running_references(spark, tmp_path):
    drop = str(tmp_path / "drop")
    spark.createDataFrame([("A", "1", "scala", "class Foo\nval x: Foo = 1")], R.FILES).write.parquet(drop)
    q = R.running_references(R.source(spark, drop).select("path", "text"), "Foo").writeStream.format("memory").queryName("refs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["category"]: r["count"] for r in spark.table("refs").collect()} == {"Definition": 1, "UsedAsType": 1}
