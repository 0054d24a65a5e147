from nearfold.operators import minhash
from nearfold.streaming.signatures import keep_signatures, streaming_signatures


def test_streams_keep_the_batch_signatures(spark, tmp_path):
    rows = [(i % 5, u) for i in range(10) for u in range(i, i + 6)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], "item long, user long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item long, user long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {r["item"]: r.sig for r in minhash.signatures(spark.createDataFrame(rows, "item long, user long"), 16).collect()}
    q = keep_signatures(stream, str(tmp_path / "out"), str(tmp_path / "ck"), 16)
    q.awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    assert last == 2 and {r["item"]: r.sig for r in spark.read.parquet(str(tmp_path / f"out/v={last}")).collect()} == want
    q = streaming_signatures(stream, 16).writeStream.outputMode("complete").format("memory").queryName("sigs").start()
    q.processAllAvailable()
    q.stop()
    assert {r["item"]: r.sig for r in spark.table("sigs").collect()} == want
