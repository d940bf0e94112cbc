"""Streams give what batches give."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import normalize, segment
from lexloom.sources import contracts
from lexloom.streaming import streams

SF = "/root/testdata/sf0.001"


def test_clauses_of_a_stream(spark, tmp_path):
    rows = contracts.contracts(spark, SF).repartition(3)
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.documents(spark, str(tmp_path / "in"), "k long, text string", files=1)
    streams.write_clauses(stream, ["k"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = segment.clauses(rows.withColumn("text", normalize.normalized(F.col("text"))), ["k"])
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0


def test_first_seen(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.first_seen(streams.documents(spark, str(tmp_path / "in"), "user_id long, ts timestamp"), ["user_id"], "ts")
    query = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").count() == events.select("user_id").distinct().count()
