"""Queries of retrieval: BM25, vectors, fusion, ranking and its measures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import vectors
from ..tables import table as T

TERMS = ["licensed", "license", "version", "public"]


def _bm25(spark, d):
    return S.bm25(T(spark, d, "documents"), "doc_id", "text", TERMS, 50)


def _bm25_all(spark, d):
    return S.bm25(T(spark, d, "documents"), "doc_id", "text", TERMS[:2] + ["the"], 20, every=False)


def _nearest(spark, d):
    """The 20 nearest of every fiftieth vector, from all rows."""
    v = T(spark, d, "embeddings")
    return vectors.exact(v.filter("vec_id % 50 = 0"), v, "vec_id", "embedding", 20).select("query", "vec_id", "distance")


def _fused(spark, d):
    """For every fiftieth vector its neighbours, fused with the documents that answer the terms."""
    v = T(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0")
    dense = vectors.exact(asked, v, "vec_id", "embedding", 20).select("query", F.col("vec_id").alias("doc_id"), F.col("place").alias("rank"))
    lexical = S.ranked(S.bm25(T(spark, d, "documents"), "doc_id", "text", TERMS, 50), "doc_id", [F.desc("score"), F.col("doc_id")], "lexical", 0.7)
    every = asked.select(F.col("vec_id").alias("query")).join(F.broadcast(lexical))  # 50 rows a query
    legs = [every.select("query", "doc_id", "rank", "weight", "leg"), dense.withColumns({"weight": F.lit(0.3), "leg": F.lit("dense")})]
    pair = F.struct("query", "doc_id").alias("pair")
    fused = S.fuse([leg.select(pair, "rank", "weight", "leg") for leg in legs], "pair").select("pair.*", "score", "n_legs")
    return fused.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc_id"))).filter("place <= 30")


def _federated(spark, d):
    """Suppliers by balance as evidence, with quality, age and corroboration by nation."""
    s = T(spark, d, "supplier")
    per = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    met = s.join(F.broadcast(per), "s_nationkey")  # one row a nation
    fresh = S.freshness(F.col("s_suppkey") % 400, F.lit(180))
    score = S.federation_score(F.greatest(F.col("s_acctbal"), F.lit(0.0)) / 1000, (F.col("s_nationkey") % 4) / 3, fresh, F.least(F.col("n") - 1, F.lit(3)) / 3)
    return met.select("s_suppkey", fresh.alias("fresh"), score.alias("score"))


def _measures(spark, d):
    """Items as queries: documents ranked by shared words of the item, answers those that hold its first five words."""
    items = T(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.lower("text").alias("q"), F.array_distinct(S.lexemes(F.col("text"))).alias("terms"))
    long = lambda words: F.array_distinct(F.filter(words, lambda w: F.length(w) > 6))
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("item"), F.explode(long(S.lexemes(F.col("text")))).alias("term"))
    asked = items.select("query", F.explode(long(F.col("terms"))).alias("term"))
    hits = docs.join(asked, "term").groupBy("query", "item").agg(F.count(F.lit(1)).alias("n"))
    run = hits.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("n"), "item"))).filter("rank <= 20")
    answers = hits.filter("n >= 6").select("query", "item")
    return S.measures(run.select("query", "item", "rank"), answers)


def _strata(spark, d):
    m = _measures(spark, d).withColumn("stratum", F.col("query") % 4)
    return m.groupingSets([["stratum"], []], "stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("mrr"), 6).alias("mrr"))


def _sample(spark, d):
    return S.sample_cells(T(spark, d, "documents"), ["source", "lang"], "doc_id", 60).select("doc_id", "source", "lang")


def _investigate(spark, d):
    """Probes by event type, ranked by value; one row a user by 1/(30+rank) + 1/(60+probe)."""
    e = T(spark, d, "events")
    probe = F.dense_rank().over(W.orderBy("event_type"))
    types = e.select("event_type").distinct().withColumn("probe", probe)
    hits = e.join(F.broadcast(types), "event_type").withColumn("rank", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).filter("rank <= 20")
    score = F.round(1 / (30 + F.col("rank")) + 1 / (60 + F.col("probe")), 8)
    best = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "event_id"))
    return hits.withColumn("score", score).withColumn("rn", best).filter("rn = 1").select("user_id", "event_id", "score")


def _turn_hits(spark, d):
    """Conversations by their best hit and 0.2 ln(1 + hits)."""
    c = T(spark, d, "conversations").filter(F.contains(F.lower("text"), F.lit("the")))
    weight = F.when(F.col("role") == "user", 4.0).when(F.col("role") == "assistant", 2.0).otherwise(1.0)
    scored = c.withColumn("score", weight / (1 + F.col("turn") / 180))
    out = scored.groupBy("conv_id").agg(F.round(F.max("score") + 0.2 * F.log1p(F.count(F.lit(1))), 8).alias("score"), F.max_by("turn", F.struct("score", -F.col("turn"))).alias("best_turn"))
    return out.orderBy(F.desc("score"), "conv_id").limit(40)


_BM25 = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./#-]*') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
h AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w),
t AS (SELECT doc_id, length, term, count(*) AS tf FROM h WHERE term IN ({terms}) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY 1)
SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 8) AS score
FROM t JOIN f USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT {k}
"""
_NEAR = """
WITH p AS (SELECT a.vec_id AS query, b.vec_id, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query, vec_id, distance FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 20
"""
_IN = ", ".join(f"'{t}'" for t in TERMS)
_LEX = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./#-]*')"
_MEAS = f"""
WITH a AS (SELECT DISTINCT item_id AS query, unnest({_LEX}) AS term FROM benchmark),
d AS (SELECT DISTINCT doc_id AS item, unnest({_LEX}) AS term FROM documents),
h AS (SELECT query, item, count(*) AS n FROM a JOIN d USING (term) WHERE length(term) > 6 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, item) AS rank FROM h),
g AS (SELECT query, count(*) AS n FROM h WHERE n >= 6 GROUP BY 1),
x AS (SELECT query, count(*) FILTER (WHERE rank <= 5) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 5), 0) AS dcg, min(rank) AS first FROM r WHERE n >= 6 AND rank <= 20 GROUP BY 1)
SELECT query, CAST(coalesce(hits, 0) > 0 AS INT) AS hit, round(coalesce(hits, 0) / n, 8) AS recall, round(coalesce(hits, 0) / 5, 8) AS precision,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n, 5) AS BIGINT) + 1), lambda k: 1 / log2(k + 1))), 8) AS ndcg, round(coalesce(1 / first, 0), 8) AS mrr
FROM g LEFT JOIN x USING (query)
"""

QUERIES = {
    "top01_bm25": (_bm25, _BM25.format(terms=_IN, k=50)),
    "top01_bm25_common": (_bm25_all, _BM25.format(terms="'licensed', 'license', 'the'", k=20)),
    "jon21_nearest": (_nearest, _NEAR),
    "top07_fusion": (_fused, f"WITH b AS ({_BM25.format(terms=_IN, k=50)}), v AS ({_NEAR}), q AS (SELECT DISTINCT query FROM v), l AS (SELECT query, doc_id, p FROM q, (SELECT doc_id, 0.7 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS p FROM b) UNION ALL SELECT query, vec_id, 0.3 / (60 + row_number() OVER (PARTITION BY query ORDER BY distance, vec_id)) FROM v), s AS (SELECT query, doc_id, round(sum(p), 8) AS score, count(*) AS n_legs FROM l GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= 30"),
    "top13_federation": (_federated, "WITH p AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey) AS n, round(1 / (1 + (s_suppkey % 400) / 180), 9) AS fresh, greatest(s_acctbal, 0) / 1000 AS lex FROM supplier) SELECT s_suppkey, fresh, round(0.45 * lex / (1 + lex) + 0.30 * (s_nationkey % 4) / 3 + 0.10 * fresh + 0.15 * least(n - 1, 3) / 3, 9) AS score FROM p"),
    "agg14_measures": (_measures, _MEAS),
    "agg15_strata": (_strata, f"SELECT query % 4 AS stratum, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM ({_MEAS}) GROUP BY GROUPING SETS ((query % 4), ())"),
    "top22_sample": (_sample, "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS turn FROM documents) ORDER BY turn, source, lang LIMIT 60"),
    "top16_investigate": (_investigate, "WITH h AS (SELECT *, dense_rank() OVER (ORDER BY event_type) AS probe, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) SELECT user_id, event_id, round(1 / (30 + rank) + 1 / (60 + probe), 8) AS score FROM h WHERE rank <= 20 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(1 / (30 + rank) + 1 / (60 + probe), 8) DESC, event_id) = 1"),
    "agg12_session_score": (_turn_hits, "WITH s AS (SELECT conv_id, turn, (CASE role WHEN 'user' THEN 4.0 WHEN 'assistant' THEN 2.0 ELSE 1.0 END) / (1 + turn / 180) AS score FROM conversations WHERE lower(text) LIKE '%the%') SELECT conv_id, round(max(score) + 0.2 * ln(1 + count(*)), 8) AS score, first(turn ORDER BY score DESC, turn) AS best_turn FROM s GROUP BY 1 ORDER BY score DESC, conv_id LIMIT 40"),
}
