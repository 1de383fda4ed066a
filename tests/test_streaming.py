from pyspark.sql import functions as F

from vellumlake.operators import ordered as O
from vellumlake.streaming import diagnostics as D


def test_stream_equals_batch(spark, tmp_path):
    ids = ["a", "b", "scan_summary"]
    rows = [("r", ids[i % 3], i) for i in range(120)]
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "run string, id string, ordinal bigint").coalesce(1).write.mode("append").json(str(src))
    stream = spark.readStream.schema("run string, id string, ordinal bigint").option("maxFilesPerTrigger", 1).json(str(src))
    out = []

    def each(batch, epoch):
        out.extend((r.id, r["rank"]) for r in batch.collect() if r.within)

    q = D.per_id(stream, 25).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = O.budgeted(spark.createDataFrame(rows, "run string, id string, ordinal bigint"), ["run"], "id", "ordinal", 25, 10**6).where("kept")
    assert {i: sum(x == i for x, _ in out) for i in ids} == {r.id: r.n for r in batch.groupBy("id").agg(F.count("*").alias("n")).collect()}


def test_total_cap(spark):
    batch = spark.createDataFrame([("r", "a", 1, True), ("r", "b", 2, True), ("r", "scan_summary", 3, True), ("r", "b", 4, True)], "run string, id string, ordinal bigint, within boolean")
    assert [r.kept for r in D.with_total(batch, None, 2).orderBy("ordinal").collect()] == [True, True, True, False]
    used = spark.createDataFrame([("r", 1)], "run string, used int")
    assert [r.kept for r in D.with_total(batch, used, 2).orderBy("ordinal").collect()] == [True, False, True, False]
