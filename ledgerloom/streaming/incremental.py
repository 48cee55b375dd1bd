"""Files as a stream: each batch adds what is new by its hash, once, across restarts; and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_new(spark: SparkSession, path: str, schema: T.StructType | str, target: str, checkpoint: str, key: str = "sha256") -> StreamingQuery:
    """JSON files that arrive at ``path``; rows whose key the target lacks are appended. Ends when all that is there is read."""
    incoming = spark.readStream.schema(schema).json(path)

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(batch.sparkSession.read.parquet(target).select(key), key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """events: ts, event_type, value; batch or stream. Tumbling windows; a stream closes a window once it is ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
