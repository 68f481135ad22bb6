"""The streaming block means equal the batch ones once the watermark has passed."""

from pyspark.sql import functions as F

from fluxloom.streaming.periods import stream_block_means


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, i * 7, float(i % 5)) for k in ("a", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "key string, s long, x double").select("key", F.timestamp_seconds("s").alias("ts"), "x")
    df.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("z", 10**6, 0.0)], "key string, s long, x double").select("key", F.timestamp_seconds("s").alias("ts"), "x")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = stream_block_means(stream, ["key"], "ts", "1 minute", ["x"], "10 seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    late.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.period_start): (r.x_mean, r.n) for r in spark.table("blocks").collect() if r.key != "z"}
    want = {(r.key, r.w.start): (r.m, r.n) for r in df.groupBy("key", F.window("ts", "1 minute").alias("w")).agg(
        F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want
