"""Closure over parent and fork edges by doubling: strides of 1, 2, 4, ... edges, and reach put together from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import durable

#: A table of strides may have so many rows a row of edges; then no longer strides are made.
MOST_STRIDES = 4


def strides(edges: DataFrame, most: int | None = None) -> list[DataFrame]:
    """Tables (parent, child) of nodes that lie 1, 2, 4, ... edges apart, each the square of the one before.

    They end where no walk is that long, beyond `most` edges or the number of edges, or
    where squares grow beyond MOST_STRIDES times the edges: trees and chains have fewer
    rows each time, graphs with many parents may have more.
    """
    out = [durable(edges.select("parent", "child").filter("parent != child").distinct())]
    n = out[0].count()
    while 1 << len(out) <= min(n, n if most is None else most):
        a, b = out[-1].select("parent", F.col("child").alias("mid")), out[-1].select(F.col("parent").alias("mid"), "child")
        twice = durable(a.join(b, "mid").select("parent", "child").filter("parent != child").distinct())
        size = twice.count()
        if not size or size > MOST_STRIDES * n:
            break
        out.append(twice)
    return out


def descendants(edges: DataFrame, roots: DataFrame, most_depth: int | None = None) -> DataFrame:
    """root, node, depth of all nodes below `roots` (root) along `edges` (parent, child), least depth; safe on cycles.

    A shortest path is a number of longest strides and then one or none of each shorter
    one, so a chain of n edges takes some 2 log n rounds. Only the longest stride is
    repeated, until it reaches nothing new. Each round is written, so a lost executor
    costs a reread.
    """
    steps = strides(edges, most_depth)
    reached = durable(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())

    def on(rows: DataFrame, k: int) -> DataFrame:
        met = rows.join(steps[k], F.col("node") == F.col("parent")).select("root", F.col("child").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        return met if most_depth is None else met.filter(F.col("depth") <= most_depth)

    frontier, top = reached, len(steps) - 1
    while True:
        new = on(frontier, top).groupBy("root", "node").agg(F.min("depth").alias("depth"))
        frontier = durable(new.join(reached.select("root", "node"), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = durable(reached.unionByName(frontier))
    for k in range(top - 1, -1, -1):
        reached = durable(reached.unionByName(on(reached, k)).groupBy("root", "node").agg(F.min("depth").alias("depth")))
    return reached


def below(nodes: DataFrame, key: str, parent: str, marked: Column) -> DataFrame:
    """The `key` of every row of `nodes` that is marked or stands below a marked one; a row has one parent at most.

    Pointers to ancestors double their reach each round, so a chain of n rows takes
    log n rounds. A chain passes its mark on without gaps: a round that marks nothing
    new is the last, on cycles too.
    """
    state = durable(nodes.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.coalesce(marked, F.lit(False)).alias("gone")))
    n = state.filter("gone").count()
    while True:
        above = state.select(F.col("k").alias("up"), F.col("up").alias("next"), F.col("gone").alias("above"))
        state = durable(state.join(above, "up", "left").select("k", F.col("next").alias("up"), (F.col("gone") | F.coalesce("above", F.lit(False))).alias("gone")))
        now = state.filter("gone").count()
        if now == n:
            return state.filter("gone").select(F.col("k").alias(key))
        n = now
