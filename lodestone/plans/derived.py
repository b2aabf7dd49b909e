"""Queries of passages, audits and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, contextual, passages
from ..tables import table as T

def _passages(spark, d):
    p = passages.passages(T(spark, d, "documents"), 64, 16)
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("n_tokens"))


def _rebuilt(spark, d):
    """Documents that their passages or chunks do not give back: none."""
    docs = T(spark, d, "documents")
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = lambda built: known.select("doc_id").join(built, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = whole(passages.rebuilt(passages.passages(docs, 64, 16), "end"))
    chunked = whole(passages.rebuilt(passages.chunks(docs, 1000)))
    return audits.differing(known, cut, "doc_id", "text").union(audits.differing(known, chunked, "doc_id", "text"))


def _chunks(spark, d):
    return passages.chunks(T(spark, d, "documents"), 1000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("most"))


def _context(spark, d):
    c = T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"))
    return passages.context(c)


def _contextual(spark, d):
    """Turns as passages of conversations, whose system turns tell a label; budgets that leave some partners out."""
    c = T(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"), F.regexp_count("text", F.lit(r"[^ \t\n]+")).cast("int").alias("n_tokens"), "role", "text")
    lines = contextual.metadata_lines({"roles": F.array_join(F.array_sort(F.collect_set("role")), ", "), "turns": F.count(F.lit(1))})
    out = contextual.contextual(c, c.groupBy("doc_id").agg(lines.alias("lines")), most_tokens=300, most_bytes=2400)
    return out.select("doc_id", "ordinal", "n_support", "context_sha256")


def _gaps(spark, d):
    return audits.gaps(T(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("n")).distinct(), "l_orderkey", "n")


def _accounting(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ordinal"), "event_type")
    claims = e.filter("event_type in ('purchase', 'error')")
    ranges = e.filter("event_type = 'click'").select("key", F.col("ordinal").alias("first"), (F.col("ordinal") + 2).alias("last"))
    return audits.accounting(e, claims, ranges)


def _set_scores(spark, d):
    l = T(spark, d, "lineitem")
    return audits.set_scores(l.filter("l_quantity > 40"), l.filter("l_discount > 0.05"), "l_suppkey", "l_partkey")


def _contaminated(spark, d):
    return audits.contained(T(spark, d, "documents"), "doc_id", "text", T(spark, d, "benchmark"), "item_id", "text")


_MARK = contextual.LEFT_OUT.replace("\n", "' || chr(10) || '")
_LEFT = len(contextual.LEFT_OUT.encode())
_CONTEXTUAL = f"""
WITH RECURSIVE p AS (SELECT conv_id AS doc_id, turn AS ordinal, len(regexp_extract_all(text, '[^ \\t\\n]+')) AS tokens, role, text FROM conversations),
md AS (SELECT doc_id, 'roles: ' || string_agg(DISTINCT role, ', ' ORDER BY role) || chr(10) || 'turns: ' || count(*) AS lines FROM p GROUP BY 1),
t AS (SELECT p.*, lines, '[document context]' || chr(10) || lines || chr(10) || '[target passage ' || ordinal || ']' AS prefix FROM p JOIN md USING (doc_id)),
b AS (SELECT *, greatest(512, 2400 - strlen(prefix) - 1) AS room FROM t),
-- a character is kept if it ends within the head or begins within the tail
ch AS (SELECT doc_id, ordinal, room, x, i, sum(strlen(x)) OVER (PARTITION BY doc_id, ordinal ORDER BY i) AS upto, sum(strlen(x)) OVER (PARTITION BY doc_id, ordinal) AS size
  FROM (SELECT doc_id, ordinal, room, unnest(string_split(text, '')) AS x, generate_subscripts(string_split(text, ''), 1) AS i FROM b WHERE strlen(text) > room)),
ex AS (SELECT doc_id, ordinal, string_agg(x, '' ORDER BY i) FILTER (WHERE upto <= (room - {_LEFT} + 1) // 2) || '{_MARK}' || string_agg(x, '' ORDER BY i) FILTER (WHERE upto - strlen(x) >= size - (room - {_LEFT}) // 2) AS body FROM ch GROUP BY 1, 2),
g AS (SELECT b.*, coalesce(ex.body, b.text) AS body FROM b LEFT JOIN ex USING (doc_id, ordinal)),
c AS (SELECT a.doc_id, a.ordinal, o.ordinal AS other, o.tokens, strlen('[support passage ' || o.ordinal || ']') + strlen(o.text) + 2 AS cost, o.text,
  row_number() OVER (PARTITION BY a.doc_id, a.ordinal ORDER BY o.ordinal >= 2, CASE WHEN o.ordinal < 2 THEN o.ordinal ELSE abs(o.ordinal - a.ordinal) END, o.ordinal) AS k
  FROM p a JOIN p o ON a.doc_id = o.doc_id AND a.ordinal != o.ordinal AND (o.ordinal < 2 OR abs(o.ordinal - a.ordinal) <= 2)),
r AS (SELECT doc_id, ordinal, 0 AS k, greatest(0, 300 - tokens) AS tokens, greatest(0, 2400 - strlen(prefix) - 1 - strlen(body)) AS bytes, false AS took FROM g
  UNION ALL SELECT r.doc_id, r.ordinal, r.k + 1, CASE WHEN c.tokens <= r.tokens AND c.cost <= r.bytes THEN r.tokens - c.tokens ELSE r.tokens END, CASE WHEN c.tokens <= r.tokens AND c.cost <= r.bytes THEN r.bytes - c.cost ELSE r.bytes END, c.tokens <= r.tokens AND c.cost <= r.bytes
  FROM r JOIN c ON c.doc_id = r.doc_id AND c.ordinal = r.ordinal AND c.k = r.k + 1),
s AS (SELECT doc_id, ordinal, CAST(count(*) AS INT) AS n_support, string_agg('[support passage ' || other || ']' || chr(10) || c.text || chr(10), '' ORDER BY other) AS said FROM r JOIN c USING (doc_id, ordinal, k) WHERE took GROUP BY 1, 2)
SELECT g.doc_id, CAST(g.ordinal AS INT) AS ordinal, coalesce(n_support, 0) AS n_support, sha256('[document context]' || chr(10) || lines || chr(10) || coalesce(said, '') || '[target passage ' || g.ordinal || ']' || chr(10) || body) AS context_sha256 FROM g LEFT JOIN s USING (doc_id, ordinal)
"""

QUERIES = {
    "prj07_contextual": (_contextual, _CONTEXTUAL),
    "win09_passages": (_passages, None),
    "aud01_rebuilt": (_rebuilt, "SELECT doc_id, '' AS fault FROM documents WHERE false"),
    "str15_chunks": (_chunks, None),
    "jon20_context": (_context, "SELECT a.conv_id AS doc_id, CAST(a.turn AS INT) AS ordinal, CAST(b.turn AS INT) AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND (b.turn < 2 OR abs(a.turn - b.turn) <= 2)"),
    "aud03_gaps": (_gaps, "SELECT l_orderkey, found, expected FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS found, coalesce(CAST(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) + 1, 0) AS expected FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE found <> expected"),
    "aud04_accounting": (_accounting, "WITH e AS (SELECT user_id AS key, event_id AS ordinal, event_type FROM events), c AS (SELECT key, ordinal FROM e WHERE event_type IN ('purchase', 'error') UNION ALL SELECT key, unnest(generate_series(ordinal, ordinal + 2)) FROM e WHERE event_type = 'click'), n AS (SELECT key, ordinal, count(*) AS n FROM c GROUP BY ALL) SELECT e.key, e.ordinal, coalesce(n.n, 0) AS n FROM e LEFT JOIN n ON n.key = e.key AND n.ordinal = e.ordinal WHERE coalesce(n.n, 0) <> 1"),
    "agg20_set_scores": (_set_scores, "WITH g AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem WHERE l_quantity > 40), f AS (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem WHERE l_discount > 0.05), j AS (SELECT coalesce(g.s, f.s) AS l_suppkey, count(g.s) ng, count(f.s) nf, count(CASE WHEN g.s IS NOT NULL AND f.s IS NOT NULL THEN 1 END) nb FROM g FULL JOIN f ON g.s = f.s AND g.p = f.p GROUP BY 1) SELECT l_suppkey, round(CASE WHEN nf > 0 THEN nb / nf ELSE 1 END, 8) AS precision, round(CASE WHEN ng > 0 THEN nb / ng ELSE 1 END, 8) AS recall FROM j"),
    "aud05_contamination": (_contaminated, "WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, q)"),
}
