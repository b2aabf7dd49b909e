"""Audits of derived data: reconstruction, contiguity, accounting, contamination, set scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def differing(expected: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose digests differ, or that one side lacks: `fault` says which."""
    a, b = (df.select(F.col(key).alias("k"), F.sha2(F.col(value).cast("binary"), 256).alias("h")).alias(n) for df, n in ((expected, "a"), (stored, "b")))
    met = a.join(b, F.col("a.k") == F.col("b.k"), "full")
    fault = F.when(F.col("a.k").isNull(), "extra").when(F.col("b.k").isNull(), "missing").when(F.col("a.h") != F.col("b.h"), "differs")
    return met.select(F.coalesce("a.k", "b.k").alias(key), fault.alias("fault")).filter("fault is not null")


def gaps(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Places where ordinals of a key do not go on by one from 0."""
    w = W.partitionBy(key).orderBy(ordinal)
    want = F.coalesce(F.lag(ordinal).over(w) + 1, F.lit(0))
    return df.select(key, F.col(ordinal).alias("found"), want.alias("expected")).filter("found != expected")


def accounting(events: DataFrame, claims: DataFrame, ranges: DataFrame) -> DataFrame:
    """Events (key, ordinal) not accounted for exactly once, by claims (key, ordinal) or ranges (key, first, last)."""
    spread = ranges.select("key", F.explode(F.sequence("first", "last")).alias("ordinal"))
    once = claims.select("key", "ordinal").union(spread).groupBy("key", "ordinal").agg(F.count(F.lit(1)).alias("n"))
    return events.select("key", "ordinal").join(once, ["key", "ordinal"], "left").select("key", "ordinal", F.coalesce("n", F.lit(0)).alias("n")).filter("n != 1")


def set_scores(gold: DataFrame, found: DataFrame, group: str, item: str) -> DataFrame:
    """precision and recall of `found` against `gold` (group, item) for each group; 1 where nothing was asked."""
    a, b = gold.select(group, item).distinct().withColumn("g", F.lit(1)), found.select(group, item).distinct().withColumn("f", F.lit(1))
    got = a.join(b, [group, item], "full").groupBy(group).agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count(F.when(F.col("g") + F.col("f") == 2, 1)).alias("n_both"))
    share = lambda n: F.round(F.when(F.col(n) > 0, F.col("n_both") / F.col(n)).otherwise(1.0), 8)
    return got.select(group, share("n_found").alias("precision"), share("n_gold").alias("recall"))


#: Words of a key, and hash buckets of the filter in front of the join.
KEY_WORDS, BUCKETS = 5, 1 << 20


def contained(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """`key` and `item_key` where the item stands in the document, both lowered and with single spaces, word ends or not.

    An item that stands inside a text may begin and end within words, but its inner words are
    whole: the first KEY_WORDS of them are its key, met by an equi join with the runs of as many
    words of the texts. Items of two words or one have their first three characters as key;
    those of less than three characters (a bounded number of different ones) are looked for in
    every text. Candidates are verified on the whole text. Only runs whose bucket some item has
    are shuffled. Null texts and items are in nothing; keys of documents are not null.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    words = F.split("q", " ")
    n = F.when(F.size(words) >= 3, F.least(F.size(words) - 2, F.lit(KEY_WORDS))).when(F.length("q") >= 3, 0).otherwise(-1)
    named = items.select(F.col(item_key).alias("item"), norm(F.col(item_text)).alias("q")).filter("q is not null").withColumn("n", n)
    hashes = lambda parts: F.transform(parts, lambda x: F.xxhash64(x))
    run = lambda held, i, size: F.xxhash64(F.lit(size), F.slice(held, i, size or 3))
    own = F.when(F.col("n") == 0, run(hashes(F.split("q", "")), 1, 0))
    for size in range(1, KEY_WORDS + 1):
        own = F.when(F.col("n") == size, run(hashes(words), 2, size)).otherwise(own)
    keyed = named.filter("n >= 0").select("item", "q", own.alias("k"))
    texts = docs.select(F.col(key).alias("doc"), norm(F.col(text)).alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))

    sizes = {r["n"] for r in named.select("n").distinct().collect()}  # at most KEY_WORDS + 2 values

    def runs_of(size: int) -> Column:
        def all_of(held: Column) -> Column:  # the hashes of words, or of characters, once
            count = F.size(held) - (size or 3) + 1
            return F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: run(held, i, size))).otherwise(F.array().cast("array<bigint>"))

        return F.transform(F.array(hashes(F.split("t", " " if size else ""))), all_of)[0]

    runs = [runs_of(size) for size in sorted(sizes - {-1})]
    found = None
    if runs:
        bucket = F.pmod("k", F.lit(BUCKETS))
        said = texts.select("doc", "h", F.explode(F.array_distinct(F.concat(*runs))).alias("k"))
        may = said.withColumn("b", bucket).join(F.broadcast(keyed.select(bucket.alias("b")).distinct()), "b", "left_semi")
        pairs = may.join(keyed, "k").select("doc", "h", "item", "q").distinct()
        found = pairs.join(texts, ["doc", "h"]).filter(F.contains("t", "q")).select("doc", "item")
    if -1 in sizes:
        short = named.filter("n = -1").select("item", "q")
        hits = texts.join(F.broadcast(short.select("q").distinct()), F.contains("t", "q")).join(short, "q").select("doc", "item")
        found = hits if found is None else found.unionByName(hits)
    found = texts.join(named).select("doc", "item").limit(0) if found is None else found
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key))
