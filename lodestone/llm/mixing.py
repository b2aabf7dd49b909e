"""Mixing sources to target weights, to the word.

Every document gets a random key from a hash; within a source, documents in key
order form one epoch. A source that must give more words than it has repeats whole
epochs and then takes the start of one more, cut at its exact budget: the last
document is shared out by words, so a source's words meet its target to the word.

The order of a source is never sorted as a whole. Keys are hexadecimal, so their
first digits are ranges of the order: sums by range, prefix sums over those few
rows, then the one range that holds the cut is sorted. The cut is one row a source,
which any document can be held against by itself; texts are never shuffled.

Defined results: a null or empty text has size 0 and takes 0 words; a null source
is a source of its own, last in order; documents with equal keys (rows that repeat)
share the words that are left in proportion to their sizes, rounded down; null ids
count as the empty string; an empty table gives an empty result; clashing columns
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_EPOCHS = 2
SEED = "mix-1"
#: Hexadecimal digits of a range: 16^3 ranges a source.
DIGITS = 3
#: Sources up to which the cuts are broadcast; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    """128 random bits, as hexadecimal, that depend on the id alone."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """`sizes` (source, source_size: one row a source) with `target`.

    The share of all words is dealt by weight; a source stops at `most` times its
    size and the others take up the rest. Where that ends is a level: in order of
    cap per weight, sources stay capped while the level left for the others is at
    or above their own. Windows here run over one row a source.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("level", "place")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("place", F.row_number().over(in_order) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(most))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * (share_percent / 100))
        .withColumn("rest", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("share", F.col("rest") / F.col("open"))
    )
    first_open = F.min(F.when(F.col("level") > F.col("share"), F.struct("level", "place", "share"))).over(W.partitionBy())
    open_source = F.struct("level", "place") >= F.struct(F.col("first.level"), F.col("first.place"))
    return (
        ranked.withColumn("first", first_open)
        .withColumn("target", F.when(F.coalesce(open_source, F.lit(False)), F.col("weight") * F.col("first.share")).otherwise(F.col("cap")))
        .select("source", "source_size", "target")
    )


def cuts(sized: DataFrame, **kind) -> DataFrame:
    """One row a source: source_size, target, whole epochs, and where the next epoch stops.

    `sized` has source, size and key, and is read three times. Documents before
    `cut_key` are taken once more, those at it share `cut_words` of `tie_words`.
    """
    ranges = sized.groupBy("source", F.substring("key", 1, DIGITS).alias("range")).agg(F.sum("size").alias("size"))
    ranges = C.durable(ranges)
    aimed = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), **kind)
    budget = (
        aimed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", (F.floor(F.col("target") + 1e-6) - F.col("epochs") * F.col("source_size")).cast("long"))
    )
    budget = C.durable(budget)
    running = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    r, b = ranges.withColumn("upto", F.sum("size").over(running)).alias("r"), budget.alias("b")
    held = (
        r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")))
        .filter((F.col("r.upto") > F.col("b.left")) & (F.col("r.upto") - F.col("r.size") <= F.col("b.left")))
        .select(F.col("r.source").alias("source"), F.col("r.range").alias("range"), (F.col("b.left") - F.col("r.upto") + F.col("r.size")).alias("within"))
    )
    held = C.durable(held)
    s, h = sized.alias("s"), F.broadcast(held) if C.bounded(held, BROADCAST_SOURCES) else held
    h = h.alias("h")
    keys = (
        s.join(h, F.col("s.source").eqNullSafe(F.col("h.source")) & (F.substring(F.col("s.key"), 1, DIGITS) == F.col("h.range")))
        .groupBy(F.col("s.source").alias("source"), F.col("s.key").alias("key"), F.col("h.within").alias("within"))
        .agg(F.sum("s.size").alias("size"))
    )
    inside = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    k = (
        keys.withColumn("upto", F.sum("size").over(inside))
        .filter((F.col("upto") > F.col("within")) & (F.col("upto") - F.col("size") <= F.col("within")))
        .select(F.col("source"), F.col("key").alias("cut_key"), (F.col("within") - F.col("upto") + F.col("size")).alias("cut_words"), F.col("size").alias("tie_words"))
        .alias("k")
    )
    return budget.alias("b").join(k, F.col("b.source").eqNullSafe(F.col("k.source")), "left").select("b.*", "k.cut_key", "k.cut_words", "k.tie_words").drop("left")


def taken(size: Column, key: Column) -> Column:
    """Words of a document that the mix takes, given its source's cut in the same row."""
    more = (
        F.when(F.col("cut_key").isNull(), F.lit(0))
        .when(key < F.col("cut_key"), size)
        .when(key == F.col("cut_key"), F.floor(F.col("cut_words") * size / F.col("tie_words")))
        .otherwise(F.lit(0))
    )
    return (F.col("epochs") * size + more).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size and key of each row."""
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        C.n_words(F.col(f"`{text}`")).alias("size"),
        order_key(F.col(f"`{doc_id}`")).alias("key"),
    )


def with_cuts(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """`rows` (with source) beside its source's cut, which is broadcast up to BROADCAST_SOURCES rows."""
    cut = C.durable(cut)
    if C.bounded(cut, BROADCAST_SOURCES):
        cut = F.broadcast(cut)
    cut = cut.withColumnRenamed("source", "__source")
    return rows.join(cut, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def query(docs: DataFrame) -> DataFrame:
    rows = C.durable(sized(docs))
    return with_cuts(rows, cuts(rows)).select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of `docs` that the mix takes, with `epoch` (from 1) and `taken_words`.

    A document appears once for each epoch that takes it. In the last epoch of a
    source, the document at the cut is taken for `taken_words` of its words only;
    its text stays whole.
    """
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(f"`{source}`").cast("string").alias("source"),
        order_key(F.col(f"`{doc_id}`")).alias("key"),
        C.n_words(F.col(f"`{text}`")).alias("size"),
    )
    small = C.durable(sized(docs, doc_id, source, text).select("source", "size", "key"))
    mixed = with_cuts(rows, cuts(small)).withColumn("taken", taken(F.col("size"), F.col("key"))).filter("taken > 0")
    epochs = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    out = mixed.select("row", "size", "taken", F.explode(epochs).alias("epoch"))
    out = out.withColumn("taken_words", F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")))
    return out.select(*[F.col("row")[c].alias(c) for c in names if c.lower() not in ("epoch", "taken_words")], "epoch", "taken_words")


def oracle(n_weights: tuple[int, ...] = WEIGHTS) -> str:
    """DuckDB SQL for `query`: one sorted prefix sum a source in place of ranges."""
    weight = f"list_extract({list(map(float, n_weights))}, CAST((rank() OVER (ORDER BY source NULLS LAST) - 1) % {len(n_weights)} + 1 AS BIGINT))"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, {weight} AS weight, {float(MOST_EPOCHS)} * source_size AS cap FROM per),
lvl AS (SELECT *, cap / weight AS level, {SHARE_PERCENT / 100} * (SELECT sum(source_size) FROM per) AS total FROM w),
capped AS (
  SELECT a.source, a.level,
         (any_value(a.total) - coalesce(sum(b.cap) FILTER (WHERE b.level < a.level), 0)) / sum(b.weight) FILTER (WHERE b.level >= a.level) AS share
  FROM lvl a, lvl b GROUP BY a.source, a.level),
line AS (SELECT coalesce(min(share) FILTER (WHERE share < level), 1e300) AS share FROM
         (SELECT *, row_number() OVER (ORDER BY level) AS rn FROM capped WHERE share < level) WHERE rn = 1),
aimed AS (SELECT source, source_size, CASE WHEN level > (SELECT share FROM line) THEN weight * (SELECT share FROM line) ELSE cap END AS target FROM lvl),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aimed),
budget2 AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) - epochs * source_size AS rest FROM budget),
ties AS (SELECT source, key, CAST(sum(size) AS BIGINT) AS tie FROM sized GROUP BY ALL),
pre AS (SELECT *, CAST(sum(tie) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) - tie AS before FROM ties)
SELECT s.doc_id, s.size, b.source_size, b.target,
       CAST(b.epochs * s.size + CASE WHEN p.tie = 0 OR p.before >= b.rest THEN 0
         WHEN p.before + p.tie <= b.rest THEN s.size
         ELSE ((b.rest - p.before) * s.size) // p.tie END AS BIGINT) AS taken
FROM sized s JOIN budget2 b ON s.source IS NOT DISTINCT FROM b.source
JOIN pre p ON s.source IS NOT DISTINCT FROM p.source AND s.key = p.key
"""
