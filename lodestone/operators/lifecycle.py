"""Messages and captures over their life: envelopes, edits, budgets, relations, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graphs import descendants

CAPTURE = "title string, body string, occurred_at string, tags array<string>"


def capture_envelopes(df: DataFrame, raw: str, principal: Column) -> DataFrame:
    """Captures (JSON in `raw`) as envelopes under an id from their content; the rest with why they are refused."""
    c = F.from_json(raw, CAPTURE)
    body = F.to_json(F.struct(c["title"].alias("title"), c["body"].alias("body"), c["occurred_at"].alias("occurred_at"), F.array_sort(F.array_distinct(c["tags"])).alias("tags")))
    fault = F.when(c.isNull() | c["body"].isNull(), "body").when(F.try_to_timestamp(c["occurred_at"]).isNull(), "occurred_at")
    digest = F.sha2(body.cast("binary"), 256)
    return df.withColumns({"content": body, "sha256": digest, "native_id": F.concat(F.lit("cap_"), F.substring(digest, 1, 32)), "principal": principal, "fault": fault})


def settled(df: DataFrame, key: list[str], order: str, kind: str, text: str) -> DataFrame:
    """What edits and deletions leave: the last text of each message that is not deleted at its end."""
    last = df.groupBy(*key).agg(F.max_by(kind, order).alias("last"), F.max_by(text, F.when(F.col(kind) != "delete", F.col(order))).alias("text"), F.count(F.lit(1)).alias("n_changes"))
    return last.filter("last != 'delete'").drop("last")


def within_budget(df: DataFrame, key: str, ts: str, tie: str, seconds: int, most: int = 1) -> DataFrame:
    """`df` with `allowed`: the first `most` requests of a key in each window of `seconds`."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    w = W.partitionBy(key, slot).orderBy(ts, tie)
    return df.withColumn("allowed", F.row_number().over(w) <= most)


def relations(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """root, node, depth along child and fork edges (parent, child) in both directions, to the end unless a depth is asked for."""
    both = edges.select("parent", "child").union(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    return descendants(both, roots, most_depth)


def disagreements(boundaries: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose revision at the boundary is not the stored one."""
    a, b = boundaries.select(key, F.col(value).alias("at_boundary")), stored.select(key, F.col(value).alias("stored"))
    return a.join(b, key, "full").filter(~F.col("at_boundary").eqNullSafe(F.col("stored")))
