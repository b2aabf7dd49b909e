"""Exact order statistics by group, with no group in one buffer or one sort.

Groups that hold many rows are searched by value: approximate quantiles (a sketch of
bounded size) split what is open of a group, rows are counted between and at the
splitters with partial sums, and only the stretch that holds a wanted rank stays open.
A splitter is a value of the data and has a cell of its own, so a stretch always
shrinks and a value that a third of all rows share is settled at once. Stretches of at
most `small` rows are numbered directly. The rows themselves are not shuffled by any of
this; the other groups, each below a share of the rows, are numbered by a window.

Values are numbers, dates or timestamps; null values have no rank, NaN comes last.
Group columns may be null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import durable

#: A group with over this part of the rows is searched by value; fewer groups than this number can be.
SHARE = 10_000
SPLITTERS = 63
SMALL = 100_000


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _within(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """`rows` (by, v) with the span (s_low, s_high and what else it has) they lie in; few spans, so broadcast."""
    inside = (F.col("r.v") >= F.col("s.s_low")) & (F.col("r.v") <= F.col("s.s_high"))
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in by]
    return rows.alias("r").join(F.broadcast(spans).alias("s"), _same("r", "s", by) & inside).select(*[F.col(f"r.{k}") for k in by], "r.v", *extra)


def _numbered(rows: DataFrame, wanted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, rank, value and below for rows (keys, v, ranks: array of (rank, here)) sorted within `keys`."""
    w = W.partitionBy(*keys).orderBy("v")
    placed = rows.select(*by, "ranks", "v", F.row_number().over(w).alias("place"), (F.rank().over(w) - 1).alias("under"))
    hits = placed.select(*by, "v", "under", "place", F.explode(F.filter("ranks", lambda x: x["here"] == F.col("place"))).alias("x"))
    return hits.select(*by, F.col("x.rank").alias("rank"), F.col("v").alias("value"), (F.col("x.base") + F.col("under")).alias("below"))


def _by_value(rows: DataFrame, ends: DataFrame, by: list[str], small: int) -> DataFrame:
    """by, rank, value and below for the wanted ranks of large groups.

    `ends`: by, s_low, s_high, n, and rank, here (the rank within the span) and base
    (rows of the group below the span). Each round leaves a table of at most
    SHARE x ranks rows.
    """
    span, settled = [*by, "s_low", "s_high"], []
    open_ = durable(ends)
    while True:
        one = F.col("s_low").eqNullSafe(F.col("s_high"))
        settled.append(open_.filter(one).select(*by, "rank", F.col("s_low").alias("value"), F.col("base").alias("below")))
        few = open_.filter(~one & (F.col("n") <= small))
        grouped = few.groupBy(*span).agg(F.collect_list(F.struct("rank", "here", "base")).alias("ranks"))
        settled.append(_numbered(_within(rows, grouped, by), few, span, by))
        open_ = open_.filter(~one & (F.col("n") > small))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        cuts = F.array(*[F.lit(k / (SPLITTERS + 1)) for k in range(1, SPLITTERS + 1)])
        spans = open_.select(*span).distinct()
        split = durable(_within(rows, spans, by).groupBy(*span).agg(F.array_distinct(F.percentile_approx("v", cuts, 10_000)).alias("at")))
        cell = 2 * F.size(F.filter("at", lambda s: s < F.col("v"))) + F.array_contains("at", F.col("v")).cast("int")
        counts = _within(rows, split, by).groupBy(*span, cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(W.partitionBy(*span).orderBy("cell")) - F.col("n")
        cells = counts.withColumn("before", before)
        met = open_.alias("o").join(cells.alias("c"), _same("o", "c", span) & (F.col("o.here") > F.col("c.before")) & (F.col("o.here") <= F.col("c.before") + F.col("c.n")))
        open_ = durable(met.select(
            *[F.col(f"o.{k}") for k in by], F.col("c.low").alias("s_low"), F.col("c.high").alias("s_high"), "c.n",
            "o.rank", (F.col("o.here") - F.col("c.before")).alias("here"), (F.col("o.base") + F.col("c.before")).alias("base"),
        ))


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: Column, small: int = SMALL) -> DataFrame:
    """by, rank, n, value and below of each group of `df`: the value at each rank and the number of smaller ones.

    `ranks` is an array of ranks from 1 on, an expression over the group's columns and
    `n`, its number of values; those beyond 1 to n are left out. Groups without a value
    give no row.
    """
    names = [f"g{k}" for k in range(len(by))]
    rows = df.select(*[F.col(b).alias(g) for b, g in zip(by, names, strict=True)], F.col(value).alias("v")).filter("v is not null")
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("s_low"), F.max("v").alias("s_high"))
    named = sizes.select("*", *[F.col(g).alias(b) for b, g in zip(by, names, strict=True)]).withColumn("wanted", ranks).select(*sizes.columns, "wanted")
    asked = durable(named.withColumn("wanted", F.array_distinct(F.filter("wanted", lambda r: (r >= 1) & (r <= F.col("n"))))))
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = (F.col("n") * SHARE > total) & (F.col("n") > small)
    ends = asked.filter(large).select("*", F.explode("wanted").alias("rank")).withColumn("here", F.col("rank")).withColumn("base", F.lit(0).cast("long")).drop("wanted")
    rest = asked.filter(~large).select(*names, F.transform("wanted", lambda r: F.struct(r.alias("rank"), r.alias("here"), F.lit(0).cast("long").alias("base"))).alias("ranks"))
    out_rows = rows.alias("r").join(rest.alias("s"), _same("r", "s", names)).select(*[F.col(f"r.{g}") for g in names], "r.v", "s.ranks")
    found = _numbered(out_rows, rest, names, names)
    if not ends.isEmpty():
        found = found.unionByName(_by_value(rows, ends, names, small))
    met = found.alias("f").join(asked.alias("a"), _same("f", "a", names))
    return met.select(*[F.col(f"f.{g}").alias(b) for b, g in zip(by, names, strict=True)], "f.rank", "a.n", "f.value", "f.below")


def percentiles(df: DataFrame, by: list[str], value: str, between: dict[str, float], nearest: dict[str, float], small: int = SMALL) -> DataFrame:
    """A row a group with exact percentiles: `between` interpolates as `percentile` does, `nearest` takes the value at ceil(q n)."""
    low = lambda q: F.floor(F.lit(q) * (F.col("n") - 1)).cast("long") + 1
    high = lambda q: F.ceil(F.lit(q) * (F.col("n") - 1)).cast("long") + 1
    near = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))).cast("long")
    ranks = F.array(*[f(q) for q in between.values() for f in (low, high)], *[near(q) for q in nearest.values()])
    found = at_ranks(df, by, value, ranks, small).groupBy(*by).agg(F.any_value("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    got = lambda f, q: F.element_at("m", f(q))
    part = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    interpolated = [(got(low, q) + (got(high, q) - got(low, q)) * part(q)).alias(name) for name, q in between.items()]
    return found.select(*by, "n", *interpolated, *[got(near, q).alias(name) for name, q in nearest.items()])


def buckets(df: DataFrame, by: str, value: str, tie: str, n_buckets: int, small: int = SMALL) -> DataFrame:
    """`df` with bucket: floor(n_buckets i / n) of the row at place i of its group by (value, tie), neither null.

    The first row of each bucket is searched, by value and then, among rows of that
    value, by tie; each row then counts the first rows that it does not precede.
    """
    firsts = F.array(*[F.ceil(F.lit(k) * F.col("n") / n_buckets).cast("long") + 1 for k in range(1, n_buckets)])
    edges = durable(at_ranks(df, [by], value, firsts, small).withColumn("left", F.col("rank") - F.col("below")))
    asked = edges.groupBy(by, "value", "below", "n").agg(F.collect_list("left").alias("lefts"))
    near = df.select(F.col(by).alias("__by"), F.col(value).alias("__value"), F.col(tie).alias("__tie")).alias("d")
    near = near.join(asked.alias("e"), F.col("d.__by").eqNullSafe(F.col(f"e.{by}")) & (F.col("d.__value") == F.col("e.value"))).select("__by", "__tie", F.struct("__by", "__value", "lefts", "below", "n").alias("key"))
    ties = at_ranks(near, ["key"], "__tie", F.col("key.lefts"), small)
    bucket = F.floor((F.col("key.below") + F.col("rank") - 1) * n_buckets / F.col("key.n")).cast("long")
    cut = F.struct(F.struct(F.col("key.__value").alias("v"), F.col("value").alias("t")).alias("at"), bucket.alias("bucket"))
    cuts = durable(ties.groupBy(F.col("key.__by").alias("__by")).agg(F.collect_list(cut).alias("__cuts")))
    own = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))
    bucket = F.array_max(F.transform(F.filter("__cuts", lambda c: c["at"] <= own), lambda c: c["bucket"]))
    met = df.alias("d").join(cuts.alias("c"), F.col(f"d.{by}").eqNullSafe(F.col("c.__by")), "left")
    return met.select("d.*", F.coalesce(bucket, F.lit(0)).cast("long").alias("bucket"))
