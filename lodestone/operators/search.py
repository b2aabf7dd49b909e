"""Retrieval: a posting table, BM25, legs of candidates, rank fusion, relevance measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import durable

K1, B = 1.2, 0.75
RRF_K = 60
LEXEME = r"[a-z0-9][a-z0-9_./#-]*"


def lexemes(text: Column) -> Column:
    """Lowered runs of letters, digits and joiners."""
    return F.regexp_extract_all(F.lower(text), F.lit(LEXEME), F.lit(0))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf and length (terms of the document)."""
    said = df.select(key, lexemes(F.col(text)).alias("w")).withColumn("length", F.size("w"))
    return said.select(key, "length", F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, key: str, text: str, terms: list[str], k: int, every: bool = False) -> DataFrame:
    """The `k` best documents for `terms` by BM25 (any term, or every one), ties by key.

    One pass over the texts counts words and takes the terms of those that hold one;
    what it leaves is small and written. Only the postings of the terms are shuffled.
    """
    low = F.lower(F.col(text))
    holds = F.lit(False)
    for t in terms:
        holds = holds | F.contains(low, F.lit(t))
    own = F.when(holds, F.filter(lexemes(F.col(text)), lambda t: t.isin(*terms)))
    said = durable(df.select(key, F.regexp_count(low, F.lit(LEXEME)).alias("length"), own.alias("w")))
    stats = said.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    hits = said.select(key, "length", F.explode("w").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    freq = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    met = hits.join(F.broadcast(freq), "term")  # one row a query term
    idf = F.log((stats["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (stats["mean"] or 1.0)))
    scored = met.groupBy(key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    if every:
        scored = scored.filter(F.col("n_terms") == len(set(terms)))
    return scored.select(key, F.round("score", 8).alias("score")).orderBy(F.desc("score"), key).limit(k)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The `k` nearest rows to one query vector by cosine distance, exactly, ties by key."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine_distance(F.col(vector), asked), 6).alias("distance")).orderBy("distance", key).limit(k)


def ranked(leg: DataFrame, key: str, by: list[Column], name: str, weight: float = 1.0) -> DataFrame:
    """key, leg, rank (from 1) and weight of one bounded leg of candidates."""
    return leg.select(key, F.row_number().over(W.orderBy(*by)).alias("rank")).withColumns({"leg": F.lit(name), "weight": F.lit(weight)})


def fuse(legs: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the best contribution of each leg, weighted, summed by key."""
    every = legs[0]
    for leg in legs[1:]:
        every = every.unionByName(leg)
    best = every.groupBy(key, "leg").agg(F.max(F.col("weight") / (k + F.col("rank"))).alias("part"))
    return best.groupBy(key).agg(F.round(F.sum("part"), 8).alias("score"), F.count(F.lit(1)).alias("n_legs"))


def freshness(age_days: Column, half_life: Column) -> Column:
    return F.round(1 / (1 + F.greatest(age_days, F.lit(0)) / half_life), 9)


def federation_score(lexical: Column, quality: Column, fresh: Column, corroboration: Column) -> Column:
    return F.round(0.45 * lexical / (1 + lexical) + 0.30 * quality + 0.10 * fresh + 0.15 * corroboration, 9)


def measures(run: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """hit, recall, precision, ndcg (at k) and reciprocal rank of each query.

    `run`: query, item, rank from 1, unique. `answers`: query, item.
    """
    n_answers = answers.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    hits = run.join(answers.withColumn("good", F.lit(1)), ["query", "item"], "left").filter(F.col("good") == 1)
    inside = F.col("rank") <= k
    got = hits.groupBy("query").agg(F.count(F.when(inside, 1)).alias("hits"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    out = n_answers.join(got, "query", "left").fillna(0, ["hits", "dcg"])
    return out.select(
        "query",
        (F.col("hits") > 0).cast("int").alias("hit"),
        F.round(F.col("hits") / F.col("n"), 8).alias("recall"),
        F.round(F.col("hits") / k, 8).alias("precision"),
        F.round(F.col("dcg") / ideal, 8).alias("ndcg"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 8).alias("mrr"),
    )


def sample_cells(df: DataFrame, cell: list[str], key: str, n: int) -> DataFrame:
    """`n` rows dealt round-robin over the cells, in hash order within each: a sampling operator."""
    digest = F.sha2(F.col(key).cast("string").cast("binary"), 256)
    turn = F.row_number().over(W.partitionBy(*cell).orderBy(digest))
    return df.withColumn("turn", turn).orderBy("turn", *cell).limit(n)
