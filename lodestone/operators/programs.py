"""Caller programs over chosen documents: documents packed into shards of near-equal bytes, a shard a group.

Documents above a twentieth of a shard's mean are fewer than twenty a shard; they are
placed on the driver, largest first, each in the lightest shard. The others fill what is
left of each shard up to the mean: their prefix sums in hash order, from sums over ranges,
meet the shards' intervals. So no shard is heavier than the mean and a twentieth, but for
what its large documents weigh alone, and no task or driver holds the small documents.

A program is a trusted Python callable: it gets the documents of a shard as `Document`s and
yields (receipt, value) pairs. A receipt must be that of a document of the shard, or the
shard fails; a shard that fails gives a report that says so and no rows, and the others stand.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import durable

#: Part of a shard's mean above which a document is placed by itself.
LARGE = 1 / 20
#: Bytes of a shard; a shard is held by one task.
SHARD_BYTES = 64 << 20


@dataclass(frozen=True)
class Document:
    key: object
    receipt: str
    text: str


Program = Callable[[Iterable[Document]], Iterable[tuple[str, str]]]


def document_sizes(documents: DataFrame, parts: DataFrame, key: str, size: str) -> DataFrame:
    """`key` and n_bytes: the document's own `size` and those of its parts, if it has any; null sizes count as 0."""
    own = documents.groupBy(key).agg(F.sum(F.coalesce(size, F.lit(0))).alias("own"))
    more = parts.groupBy(key).agg(F.sum(F.coalesce(size, F.lit(0))).alias("more"))
    return own.join(more, key, "left").select(key, (F.col("own") + F.coalesce("more", F.lit(0))).cast("long").alias("n_bytes"))


def pack(sizes: DataFrame, key: str, size: str, n_shards: int) -> DataFrame:
    """`key`, `size` and `shard` (from 0) of each row of `sizes`, whose keys are unique."""
    rows = durable(sizes.select(key, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias(size)).withColumn("__h", F.xxhash64(key)))
    mean = (rows.agg(F.sum(size)).first()[0] or 0) / n_shards
    big = rows.filter(F.col(size) > mean * LARGE).select(key, size).orderBy(F.desc(size), key).collect()  # under n_shards / LARGE rows
    loads, placed = [(0, k) for k in range(n_shards)], []
    for r in big:
        load, shard = heapq.heappop(loads)
        placed.append((r[key], r[size], shard))
        heapq.heappush(loads, (load + r[size], shard))

    # intervals of the small documents' prefix sums, one a shard with room
    rooms, upto = [], 0.0
    for load, shard in sorted(loads, key=lambda x: x[1]):
        if load < mean:
            rooms.append((shard, upto, upto + mean - load))
            upto += mean - load
    spark = sizes.sparkSession
    large = spark.createDataFrame(placed, rows.select(key, size).schema.add("shard", "integer"))
    if not rooms:  # nothing but empty documents is left
        rooms = [(0, 0.0, 1.0)]
    last = max(r[2] for r in rooms)
    room = F.broadcast(spark.createDataFrame(rooms, "shard int, a double, b double"))  # a row a shard
    small = rows.filter(F.col(size) <= mean * LARGE)
    ranged = durable(small.repartitionByRange(F.col("__h"), F.col(key)).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(size).alias("n"))
    before = sums.select(F.col("__part").alias("__of"), F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum(size).over(W.partitionBy("__part").orderBy("__h", key).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size)
    at = F.least(F.col("__before") + F.col("__in"), F.lit(last) - 1e-9)
    dealt = ranged.withColumn("__in", within).join(F.broadcast(before), F.col("__part") == F.col("__of")).withColumn("__at", at)
    dealt = dealt.join(room, (F.col("__at") >= F.col("a")) & (F.col("__at") < F.col("b")))
    return dealt.select(key, size, "shard").unionByName(large)


def _run(key: str, program: Program) -> Callable[[pd.DataFrame], pd.DataFrame]:
    columns = ["shard", "kind", "receipt", "value", "n_docs", "n_bytes", "complete", "reason"]

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        docs = [Document(k, r, t or "") for k, r, t in zip(shard[key], shard["receipt"], shard["text"], strict=True)]
        number, known, out, reason = int(shard["shard"].iloc[0]), set(shard["receipt"]), [], None
        try:
            for receipt, value in program(docs):
                if receipt not in known:
                    raise PermissionError("receipt of no document of the shard")
                out.append((number, "row", receipt, str(value), None, None, None, None))
        except Exception as e:  # one shard's failure is its own: the caller is told by its report
            out, reason = [], f"{type(e).__name__}: {e}"
        out.append((number, "report", None, None, len(docs), int(shard["n_bytes"].sum()), reason is None, reason))
        return pd.DataFrame(out, columns=columns).astype({"n_docs": "Int64", "n_bytes": "Int64", "complete": "boolean"})

    return run


RESULT = "shard int, kind string, receipt string, value string, n_docs long, n_bytes long, complete boolean, reason string"


def run_program(documents: DataFrame, key: str, text: str, program: Program, n_shards: int | None = None) -> DataFrame:
    """Rows (kind 'row': receipt, value) and a report a shard (kind 'report') of `program` over all `documents`.

    Keys are unique. `n_shards` follows from the bytes by default, SHARD_BYTES each. Written once, so that looking
    at rows and reports does not run the program again.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = documents.select(key, F.octet_length(body).cast("long").alias("n_bytes"))
    if n_shards is None:
        n_shards = max(1, -(-(sized.agg(F.sum("n_bytes")).first()[0] or 0) // SHARD_BYTES))
    shards = pack(sized, key, "n_bytes", n_shards)
    rows = documents.select(key, body.alias("text"), F.sha2(F.concat_ws("\0", F.col(key).cast("string"), body).cast("binary"), 256).alias("receipt"))
    return durable(rows.join(shards, key).groupBy("shard").applyInPandas(_run(key, program), RESULT))


def run_on(documents: DataFrame, key: str, text: str, chosen: list, program: Program, n_shards: int = 1) -> DataFrame:
    """`run_program` over the chosen documents; none runs if one of them is not there."""
    wanted = documents.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(chosen)], documents.select(key).schema)
    held = durable(documents.join(F.broadcast(wanted), key, "left_semi").select(key, text))  # as many as the caller names
    if held.count() != len(set(chosen)):
        raise LookupError("a chosen document is not there")
    return run_program(held, key, text, program, n_shards)
