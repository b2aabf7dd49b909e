"""Revisioned, idempotent ingest of an append-only event log, and what is derived from it.

An event is (source, native_id, content, arrival, is_tombstone, parent). The same
content again is a replay of its revision; new content is the next revision. Only
the last revision of a key is live; a tombstone takes its descendants with it, and a
forgotten key never comes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graphs import below

KEY = ["source", "native_id"]


def with_content_hash(events: DataFrame) -> DataFrame:
    return events.withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))


def new_revisions(log: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The events of `batch` that `log` (source, native_id, sha256, revision) does not hold, with their revisions.

    Within the batch the first arrival of a content counts. Keys are shuffled once for
    the anti join and once for the numbering.
    """
    first = with_content_hash(batch)
    rows = F.struct("arrival", *[c for c in first.columns if c not in (*KEY, "sha256", "arrival")])
    first = first.groupBy(*KEY, "sha256").agg(F.min_by(rows, "arrival").alias("r")).select(*KEY, "sha256", "r.*")
    number = F.row_number().over(W.partitionBy(*KEY).orderBy("arrival", "sha256"))
    if log is None:
        return first.withColumn("revision", number)
    fresh = first.join(log.select(*KEY, "sha256"), [*KEY, "sha256"], "left_anti")
    last = log.groupBy(*KEY).agg(F.max("revision").alias("last"))
    return fresh.join(last, KEY, "left").withColumn("revision", number + F.coalesce("last", F.lit(0))).drop("last")


def current(log: DataFrame) -> DataFrame:
    """The last revision of each key, tombstones included."""
    row = F.struct("revision", *[c for c in log.columns if c not in (*KEY, "revision")])
    return log.groupBy(*KEY).agg(F.max_by(row, "revision").alias("r")).select(*KEY, "r.*").select(*log.columns)


def live(log: DataFrame) -> DataFrame:
    """Current rows that are no tombstones and stand below none, however far."""
    now = current(log)
    up = F.when(F.col("parent").isNotNull(), F.struct("source", F.col("parent").alias("native_id")))
    gone = below(now.withColumns({"key": F.struct(*KEY), "up": up}), "key", "up", F.col("is_tombstone")).select("key.*")
    return now.join(gone, KEY, "left_anti")


def without_forgotten(batch: DataFrame, forgotten: DataFrame) -> DataFrame:
    """`batch` without keys that were forgotten: they are refused for good."""
    return batch.join(forgotten.select(*KEY).distinct(), KEY, "left_anti")


def dirty_months(changed: DataFrame, first: str, last: str) -> DataFrame:
    """Months that changed spans touch, with how many: what to rebuild."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))
    return changed.select("source", F.explode(months).alias("bucket")).groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("generation"))


def reuse(wanted: DataFrame, have: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """What can be taken over by digest, and what must be computed."""
    return wanted.join(have, digest), wanted.join(have.select(digest), digest, "left_anti")
