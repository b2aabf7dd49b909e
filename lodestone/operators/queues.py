"""Queues, schedules and routing as columns and grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import durable


def next_due(now: Column, outcome: Column, failures: Column, interval: Column, jitter: Column, base: Column, most: Column, retry_after: Column) -> Column:
    """Seconds at which a job is due after `outcome`; null parks it."""
    wait = F.when(outcome == "success", interval + jitter)
    wait = wait.when(outcome == "rate_limited", F.least(most, retry_after + jitter))
    wait = wait.when(outcome == "transient", F.least(most, base * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(30)))) + jitter)
    return now + wait


def claimable(queue: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """The first queued row of each key that has no row in flight."""
    busy = queue.filter(F.col(state).isin("processing", "awaiting_ack")).select(key).distinct()
    waiting = queue.filter(F.col(state) == "queued").join(busy, key, "left_anti")
    return waiting.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def aging_order(age: Column, size: Column, stale: int = 300) -> list[Column]:
    """Stale work first by age, then the smallest."""
    return [F.when(age > stale, 0).otherwise(1), F.when(age > stale, -age).otherwise(size)]


def route(r: dict[str, Column]) -> Column:
    """Where a message goes: the first rule that holds.

    `r` gives booleans by name; a missing one is false.
    """
    on = lambda name: F.coalesce(r[name], F.lit(False)) if name in r else F.lit(False)
    silent = (
        ~on("is_message") | on("thread_mismatch") | (on("mentions_others") & ~on("mentions_self")) | on("own_bot")
        | (on("bot") & ~on("trusted")) | (on("bot") & on("trusted") & ~on("mentions_self")) | (~on("bot") & ~on("allowed_human"))
        | (~on("allowed_channel") & ~on("direct"))
    )
    bound = F.when(on("addressed") & ~on("admitted"), "silent").when(on("addressed") & on("native"), "native").when(on("addressed"), "assistant").otherwise("silent")
    return F.when(silent, "silent").when(on("bound"), bound).when(on("mentions_self") | on("direct") | on("lease"), "assistant").otherwise("silent")


def run_facts(events: DataFrame, run: str, order: str, kind: str, text: str) -> DataFrame:
    """Turns, tool calls, last message and phase of each run: one grouped fold of an event stream."""
    phase = F.when(F.col(kind) == "error", "error").when(F.col(kind) == "completed", "complete").when(F.col(kind) == "started", "running")
    return events.groupBy(run).agg(
        F.count(F.when(F.col(kind) == "started", 1)).alias("turns"),
        F.count(F.when(F.col(kind) == "tool", 1)).alias("tool_calls"),
        F.max_by(text, F.when(F.col(kind) == "message", F.col(order))).alias("last_message"),
        F.max_by(phase, F.when(phase.isNotNull(), F.col(order))).alias("phase"),
    )


def lightest_bins(df: DataFrame, group: str, key: str, size: str, bins: int) -> DataFrame:
    """Rows of each group dealt to `bins` by size, largest first, ties by key, in snake order: 0 to bins - 1, then back.

    Not the exact greedy order, in which each row goes to the lightest bin so far, and which
    is one fold over the whole group: counts of bins differ by 1 at most, and the totals of two
    bins by no more than the largest size (of sizes not below 0), but the greedy totals lie
    closer. Ranks are prefix sums over ranges of rows, so no group is held by one task.
    A null key is the first of equals; rows that repeat a key and a size come in any order.
    """
    slim = df.select(group, key, F.col(size).cast("long").alias(size))
    order = [F.col(size).desc(), F.col(key)]
    ranged = durable(slim.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    own = ranged.withColumn("__k", F.row_number().over(W.partitionBy(group, "__part").orderBy(*order)) - 1)
    ranks = own.join(counts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
    turn = F.pmod(F.col("__before") + F.col("__k"), F.lit(2 * bins))
    return ranks.select(group, key, size, F.when(turn < bins, turn).otherwise(2 * bins - 1 - turn).cast("int").alias("bin"))
