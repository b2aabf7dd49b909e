"""Resumable backfills by key ranges, and rebuilds from a log.

The ranges of a backfill are planned once, up to the greatest key there is then, and
written. Its progress is the dataset it writes: a range is a partition of it, done once
the manifest names it. A run takes the next open ranges, some at a time as one Spark job,
and commits them together; a run that is killed leaves a build that no manifest names, and
the next run goes on with the ranges that are open. Each range holds a row that only says
it is done, so ranges without results are not asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.generations import Dataset

#: Rows of a range, about, and ranges that one job does.
RANGE_ROWS, AT_ONCE = 1_000_000, 64


def plan(rows: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> list[tuple[int, int]]:
    """Bounds (first, last) of ranges of a whole-number key that cover all keys there are, about `range_rows` rows each."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b")).first()
    if size["a"] is None:
        return []
    n = max(1, round(size["n"] / range_rows))
    cuts = sorted({int(c) for c in rows.approxQuantile(key, [k / n for k in range(1, n)], 0.1 / n)}) if n > 1 else []
    starts = [size["a"], *[c for c in cuts if size["a"] < c <= size["b"]]]
    return list(zip(starts, [s - 1 for s in starts[1:]] + [size["b"]], strict=True))


class Backfill:
    """A backfill of `make(rows)` over `rows` by `key` into a dataset partitioned by `range`.

    `out` has columns `range` and `done` beside those of `make`: a range is one row with
    `done` true and those that `make` gives.
    """

    def __init__(self, out: Dataset, key: str, make: Callable[[DataFrame], DataFrame], range_rows: int = RANGE_ROWS, at_once: int = AT_ONCE):
        self.out, self.key, self.make, self.range_rows, self.at_once = out, key, make, range_rows, at_once
        self.plans = Dataset(out.spark, f"{out.path}/plan", ["part"], "range int, first long, last long, part int")

    def ranges(self, rows: DataFrame) -> list[tuple[int, int, int]]:
        """range, first and last, planned at the first call and then kept."""
        if not self.plans.generation():
            bounds = [(k, a, b, 0) for k, (a, b) in enumerate(plan(rows, self.key, self.range_rows))]
            self.plans.commit(self.plans.stage(self.out.spark.createDataFrame(bounds, self.plans.schema)))
        return sorted((r["range"], r["first"], r["last"]) for r in self.plans.read().collect())

    def open(self, rows: DataFrame) -> list[tuple[int, int, int]]:
        done = self.out.manifest()
        return [r for r in self.ranges(rows) if self.out.name_of(range=r[0]) not in done]

    def run(self, rows: DataFrame, most_jobs: int | None = None) -> int:
        """Does open ranges, in `most_jobs` jobs or all; how many are open then. Safe to call again at any time."""
        while left := self.open(rows):
            if most_jobs == 0:
                break
            todo = left[: self.at_once]
            bounds = F.broadcast(self.out.spark.createDataFrame(todo, "range int, __first long, __last long"))  # at most `at_once` rows
            inside = rows.filter(F.col(self.key).between(todo[0][1], todo[-1][2]))
            dealt = inside.join(bounds, F.col(self.key).between(F.col("__first"), F.col("__last"))).drop("__first", "__last")
            made = self.make(dealt).withColumn("done", F.lit(False))
            marks = self.out.spark.createDataFrame([(k, True) for k, _, _ in todo], "range int, done boolean")
            build = self.out.stage(made.unionByName(marks, allowMissingColumns=True), [self.out.name_of(range=k) for k, _, _ in todo])
            self.out.commit(build)  # stale: another run did them
            most_jobs = None if most_jobs is None else most_jobs - 1
        return len(left)

    def result(self) -> DataFrame:
        return self.out.read().filter("not done").drop("done", "range")


def rebuild(out: Dataset, rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The whole projection anew from the log `rows`: the same job over all ranges, whatever was done before."""
    fresh = Dataset(out.spark, f"{out.path}/rebuilt={out.generation()}", out.keys, out.schema)
    job = Backfill(fresh, key, make, range_rows)
    job.run(rows)
    return job.result()
