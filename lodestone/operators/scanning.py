"""Scans of records by literal needles and patterns, with context; pages by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def literal_scan(df: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """Rows that hold a needle, any case, with `matched`, the needles they hold in order."""
    low = F.lower(F.col(text))
    matched = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in needles]))
    return df.withColumn("matched", matched).filter(F.size("matched") > 0)


def pattern_scan(df: DataFrame, key: str, order: str, text: str, pattern: str, context: int = 0) -> DataFrame:
    """Rows that match `pattern`, and `context` neighbours on both sides, each once; `hit` marks the former."""
    hit = F.col(text).rlike(pattern)
    w = W.partitionBy(key).orderBy(order).rowsBetween(-context, context)
    return df.withColumn("hit", hit).withColumn("__near", F.max(F.col("hit").cast("int")).over(w)).filter("__near = 1").drop("__near")


def byte_page(df: DataFrame, key: str, order: str, text: str, most: int, after: Column | None = None) -> DataFrame:
    """The first rows of each key, in order, whose texts fit `most` bytes together; at least one row.

    `after` excludes what earlier pages gave.
    """
    rows = df if after is None else df.filter(F.col(order) > after)
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length(text)).over(w), F.lit(0))
    return rows.withColumn("__before", before).filter((F.col("__before") == 0) | (F.col("__before") + F.octet_length(text) <= most)).drop("__before")
