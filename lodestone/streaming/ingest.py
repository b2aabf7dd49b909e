"""Streaming ingest: micro-batches into a revisioned log, exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest

LOG = "source string, native_id string, sha256 string, content string, arrival long, occurred_at timestamp, is_tombstone boolean, parent string, revision int, batch long"


def read_log(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The log at `path`, of batches before `before` if given; empty if nothing was written."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LOG)
    log = spark.read.schema(LOG).parquet(path)
    return log if before is None else log.filter(F.col("batch") < before)


def write_batch(batch: DataFrame, batch_id: int, path: str, forgotten: DataFrame | None = None) -> None:
    """Appends what is new in `batch`; a batch that is run again replaces its own rows and no others."""
    if forgotten is not None:
        batch = ingest.without_forgotten(batch, forgotten)
    known = read_log(batch.sparkSession, path, batch_id)
    new = ingest.new_revisions(known, batch).withColumn("batch", F.lit(batch_id).cast("long"))
    new.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def start(events: DataFrame, path: str, checkpoint: str, forgotten: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Runs `events` (a stream) into the log at `path`."""
    return events.writeStream.foreachBatch(lambda b, k: write_batch(b, k, path, forgotten)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_arrivals(messages: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of `keys` within `delay`; state older than that goes."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and `by`, final once the watermark passes."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Session windows of `by`: start, end and number of events."""
    out = events.withWatermark(at, delay).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
