"""Streams against the same statistics in batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from melisma.streaming import sessions


def run(spark, tmp_path, make, name):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=m), float(m)) for k in (1, 2) for m in (0, 5, 9, 50 * k, 50 * k + 3, 300)]
    spark.createDataFrame(rows, "k int, ts timestamp, v double").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.outputMode("complete" if name == "features" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect(), rows


def test_session_chunks(spark, tmp_path):
    got, _ = run(spark, tmp_path, lambda s: sessions.session_chunks(s, "k", "ts", "20 minutes", "1 minute"), "chunks")
    assert sorted((r["k"], r["n"]) for r in got) == [(1, 2), (1, 3), (2, 2), (2, 3)]


def test_window_features(spark, tmp_path):
    got, rows = run(spark, tmp_path, lambda s: sessions.window_features(s, "k", "ts", "v"), "features")
    batch = spark.createDataFrame(rows, "k int, ts timestamp, v double").groupBy("k", F.window("ts", "1 hour").alias("w")).agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r["k"], r["on"], r["m"], r["n"]) for r in got) == sorted((r["k"], r["w"]["start"], r["m"], r["n"]) for r in batch)
