"""The same transforms over file streams: clauses as documents arrive, and keys that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions import rules as R
from lexloom.operators import normalize, segment


def documents(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def write_clauses(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Clauses of each micro-batch, appended; a batch that runs again replaces its own folder, so that none is doubled."""

    def batch(rows: DataFrame, number: int) -> None:
        done = rows.withColumn("text", normalize.normalized(F.col("text")))
        segment.clauses(done, keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], ts: str, days: int = R.CACHE_DAYS) -> DataFrame:
    """Rows whose keys were not seen within the time that a cache entry lives; state is dropped as the watermark passes."""
    return stream.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark(keys)


def request_counts(stream: DataFrame, client: str, ts: str, seconds: int = R.RATE_SECONDS) -> DataFrame:
    """Requests of a client in each tumbling window, late ones up to a window included."""
    return stream.withWatermark(ts, f"{seconds} seconds").groupBy(F.window(ts, f"{seconds} seconds"), client).count()
