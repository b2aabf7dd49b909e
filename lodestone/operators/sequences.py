"""Analysis of ordered rows: episodes, runs, pairs, overlapping chunks, interval cover."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_US = 1800 * 1_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def with_episodes(df: DataFrame, key: str, ts: str, tie: str, starts: Column | None = None, gap_us: int = GAP_US) -> DataFrame:
    """`df` with `episode`, from 1: a new one where `starts` holds or the gap is over `gap_us`, in microseconds."""
    w = W.partitionBy(key).orderBy(ts, tie)
    begins = F.coalesce(_micros(ts) - F.lag(_micros(ts)).over(w) > gap_us, F.lit(True))
    if starts is not None:
        begins = begins | starts
    return df.withColumn("__b", begins.cast("int")).withColumn("episode", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__b")


def repeat_runs(df: DataFrame, key: str, order: str, same: list[str], least: int = 3) -> DataFrame:
    """Runs of at least `least` neighbours that agree on `same`: first, last and length."""
    w = W.partitionBy(key).orderBy(order)
    by = W.partitionBy(key, *same).orderBy(order)
    runs = df.withColumn("__run", F.row_number().over(w) - F.row_number().over(by))
    return runs.groupBy(key, *same, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("__run")


def pair_calls(df: DataFrame, key: str, order: str, call: Column, result: Column, reset: Column, most: int = 3) -> DataFrame:
    """Each result with the pending call before it, at most `most` places back.

    A result or a reset row clears what is pending, so a call is pending only if no
    such row stands between.
    """
    w = W.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    ranked = df.withColumn("__n", F.row_number().over(w))
    marked = ranked.withColumn("__call", F.last(F.when(call, F.col("__n")), True).over(upto)).withColumn("__clear", F.last(F.when(result | reset, F.col("__n")), True).over(upto))
    at = F.when(F.col("__call") > F.coalesce("__clear", F.lit(0)), F.col("__call"))
    marked = marked.withColumn("distance", F.col("__n") - at).filter(result)
    return marked.withColumn("paired", F.coalesce(F.col("distance") <= most, F.lit(False))).drop("__n", "__call", "__clear")


def overlapping_chunks(df: DataFrame, ordinal: Column, size: int, overlap: int) -> DataFrame:
    """Rows of each chunk of `size` owned ordinals with `overlap` more on both sides; `owned` marks the former."""
    first = F.greatest(F.floor((ordinal - overlap) / size), F.lit(0))
    chunks = F.sequence(first, F.floor((ordinal + overlap) / size))
    out = df.withColumn("chunk", F.explode(chunks))
    return out.withColumn("owned", F.floor(ordinal / size) == F.col("chunk"))


def span_cover(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """covered (length of the union) and gaps (places where no span reaches) of each key's spans."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reach = df.withColumn("__reach", F.max(end).over(w))
    new = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("__reach", F.col(start))), F.lit(0))
    return reach.groupBy(key).agg(F.sum(new).alias("covered"), F.sum(F.coalesce(F.col(start) > F.col("__reach"), F.lit(False)).cast("int")).alias("gaps"))


def packets(df: DataFrame, key: str, order: str, size: str, most_rows: int = 1000, most_bytes: int = 131_072) -> DataFrame:
    """Greedy packets of each key: one closes before a row that would exceed either bound.

    Depends on all rows before, so it is a fold over each key's slim, sorted rows.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, packet, rows, held = [], 0, 0, 0
        for n in pdf[size]:
            if rows and (rows + 1 > most_rows or held + n > most_bytes):
                packet, rows, held = packet + 1, 0, 0
            rows, held = rows + 1, held + n
            out.append(packet)
        return pdf.assign(packet=out)[[key, order, size, "packet"]]

    slim = df.select(key, order, F.col(size).cast("long").alias(size))
    kinds = dict(slim.dtypes)
    return slim.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, {size} bigint, packet int")
