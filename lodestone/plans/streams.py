"""Queries that run as streams over a stored table, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..streaming import ingest as streaming
from ..streaming import keyed
from ..tables import table as T


def _events(spark, d):
    return spark.readStream.schema(T(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes no single file


def _to_end(stream: DataFrame, mode: str) -> DataFrame:
    """The rows that the stream gave: its last complete result, or all it appended."""
    spark = stream.sparkSession
    path = scratch.new_path(spark)
    write = lambda b, k: b.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={k}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch.new_path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def _windows(spark, d):
    events = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    out = _to_end(streaming.window_counts(events, "at", "event_type", "6 hours"), "complete")
    return out.select(F.unix_micros("window.start").alias("start"), "event_type", "n")


def _firsts(spark, d):
    return _to_end(_events(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


def _ingest(start):
    """The event log of `stm02_revisions`, by micro-batches into stored revisions."""

    def run(spark, d):
        rows = _events(spark, d).select(
            F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("native_id"), F.floor(F.col("value") / 10).cast("string").alias("content"), F.col("event_id").alias("arrival"),
            F.col("ts").cast("timestamp").alias("occurred_at"), (F.col("event_type") == "error").alias("is_tombstone"), F.lit(None).cast("string").alias("parent"),
        )
        path = scratch.new_path(spark)
        start(rows, path, scratch.new_path(spark)).awaitTermination()
        return streaming.read_log(spark, path).select("source", "native_id", "content", "arrival", "revision")

    return run


_REVISIONS = "WITH f AS (SELECT CAST(user_id AS VARCHAR) AS source, event_type AS native_id, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS content, min(event_id) AS arrival FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source, native_id ORDER BY arrival) AS revision FROM f"
QUERIES = {
    "stm25_stream_windows": (_windows, "SELECT (epoch_us(ts) // 21600000000) * 21600000000 AS start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    "stm20_first_arrivals": (_firsts, "SELECT DISTINCT user_id, event_type FROM events"),
    "stm01_stream_ingest": (_ingest(streaming.start), _REVISIONS),
    "stm01_keyed": (_ingest(keyed.start), _REVISIONS),
}
