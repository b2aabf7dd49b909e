"""Ranking of candidates: legs merged, tiers, evidence classes, cover density, grouped selection, fairness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import lexemes

# Weights of surfaces, and the classes of evidence with their priorities.
SURFACES = {"user": 4.0, "assistant": 2.0, "tool_input": 1.5, "tool_output": 1.0}
CLASSES = (("exact-answer", 5), ("identifier", 4), ("answer", 3), ("exact-question", 3), ("phrase", 3), ("entity", 2), ("semantic", 2), ("rewrite", 2), ("pair", 1), ("anchor", 1))
RECENCY_DAYS = 180


def merge_legs(legs: DataFrame, key: str, score: str) -> DataFrame:
    """The row of each key with the least score (ties by leg), and all its legs in order."""
    rest = [c for c in legs.columns if c != key]
    best = legs.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(score, "leg")).alias("b"), F.array_sort(F.collect_set("leg")).alias("legs"))
    return best.select(key, *[F.col("b")[c].alias(c) for c in rest if c != "leg"], "legs")


def local_score(bm: Column, surface: Column, exact: Column, age_days: Column) -> Column:
    """Relevance by surface, a bonus for exact evidence, less by age; `bm` is lower for better matches."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SURFACES.items() for x in kv]), surface), F.lit(1.0))
    return (F.greatest(F.lit(0.01), 1 - bm) * weight + F.when(exact, 10.0).otherwise(0.0)) / (1 + age_days / RECENCY_DAYS)


def evidence_priority(kind: Column) -> Column:
    out = F.lit(0)
    for name, priority in reversed(CLASSES):
        out = F.when(kind == name, priority).otherwise(out)
    return out


def cover_density(text: Column, terms: list[str]) -> Column:
    """Rank by covers: shortest extents that hold every term, each worth 1 over its length, as r/(r+1).

    A term's occurrence ends a cover if the latest places of the others lie before
    it, and the cover after it starts later; the places come in one pass of a fold.
    """
    n = len(terms)
    asked = F.array(*[F.lit(t) for t in terms])
    start = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(0).alias("from"), F.lit(0.0).alias("rank"), F.lit(0).alias("at"))

    def step(s: Column, w: Column) -> Column:
        at = s["at"] + 1
        hit = F.array_contains(asked, w)
        last = F.when(hit, F.transform(s["last"], lambda v, i: F.when(F.get(asked, i) == w, at).otherwise(v))).otherwise(s["last"])
        low = F.array_min(last)
        covers = hit & (low > s["from"])
        return F.struct(last.alias("last"), F.when(covers, low).otherwise(s["from"]).alias("from"), F.when(covers, s["rank"] + 1.0 / (at - low + 1)).otherwise(s["rank"]).alias("rank"), at.alias("at"))

    return F.aggregate(lexemes(text), start, step, lambda s: s["rank"] / (s["rank"] + 1))


def matches_query(text: Column, terms: list[str], form: str) -> Column:
    """plain: every term; web: any term; phrase: the terms side by side in order."""
    words = F.transform(lexemes(text), lambda w: w)
    if form == "phrase":
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {' '.join(terms)} "))
    held = [F.array_contains(words, t) for t in terms]
    out = held[0]
    for h in held[1:]:
        out = out & h if form == "plain" else out | h
    return out


def rounds(df: DataFrame, key: str, score: str, shard: int = 32, kept: int = 6, last: int = 8) -> DataFrame:
    """The `last` best rows by rounds: in each shard of `shard` the best `kept`, until few are left.

    No task sorts more than a shard; the best rows of all win every round.
    """
    left, n = df, df.count()
    while n > max(last * 2, shard):
        parts = -(-n // shard)
        w = W.partitionBy(F.pmod(F.xxhash64(key, F.lit(n)), F.lit(parts))).orderBy(F.desc(score), key)
        left = left.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max(kept, last)).drop("__r")
        n, before = left.count(), n
        if n >= before:
            break
    return left.orderBy(F.desc(score), key).limit(last)


def fair_turn(df: DataFrame, group: str, key: str, after: Column) -> DataFrame:
    """The next row of each group in key order after its last served `after`, from the start again at the end."""
    turn = F.row_number().over(W.partitionBy(group).orderBy(F.when(F.col(key) > after, 0).otherwise(1), key))
    return df.withColumn("__t", turn).filter("__t = 1").drop("__t")
