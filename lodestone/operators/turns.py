"""Conversation turns: what follows a question, and which answer belongs to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_turn_ids(items: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """`items` with `turn_id`: 0 before the first user row, then one more at each user row."""
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return items.withColumn("turn_id", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto))


def answers(items: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user row with the last assistant row before the next user row."""
    turned = with_turn_ids(items, key, order).filter("turn_id > 0")
    said = F.struct(F.col(order).alias("at"), F.col("text").alias("text"))
    pairs = turned.groupBy(key, "turn_id").agg(
        F.max_by(said, F.when(F.col("role") == "user", F.col(order))).alias("q"),
        F.max_by(said, F.when(F.col("role") == "assistant", F.col(order))).alias("a"),
    )
    return pairs.filter("a is not null").select(
        key,
        F.col("q.at").alias("turn"),
        F.col("q.text").alias("question"),
        F.col("a.at").alias("answer_turn"),
        F.col("a.text").alias("answer"),
    )
