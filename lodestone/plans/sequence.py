"""Queries over ordered rows: turns, episodes, runs, windows, closures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graphs, selection, sequences, turns
from ..tables import table as T


def _following(spark, d):
    """Each row with the next user turn, by a window from the next row on."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(1, W.unboundedFollowing)
    return T(spark, d, "conversations").select("conv_id", "turn", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w).alias("next_user"))


def _turn_arrays(spark, d):
    turned = turns.with_turn_ids(T(spark, d, "conversations")).filter("turn_id > 0")
    item = F.when(F.col("role") == "assistant", F.struct("turn", F.length("text").alias("n")))
    return turned.groupBy("conv_id", "turn_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["n"].cast("string")), ",").alias("lengths"),
        F.count(F.when(F.col("role") == "assistant", 1)).alias("n_responses"),
    )


def _episodes(spark, d):
    e = sequences.with_episodes(T(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "signup")
    return e.groupBy("user_id", "episode").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"), F.round(F.sum("value"), 2).alias("total"))


def _repeats(spark, d):
    return sequences.repeat_runs(T(spark, d, "events"), "user_id", "event_id", ["event_type"], 3)


def _pairs(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    return sequences.pair_calls(e, "user_id", "event_id", kind == "click", kind == "purchase", kind == "signup").select("user_id", "event_id", "distance", "paired")


def _chunks(spark, d):
    c = sequences.overlapping_chunks(T(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), 500, 3)
    return c.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("owned").cast("int")).alias("n_owned"), F.sum("o_orderkey").alias("total"))


def _cover(spark, d):
    spans = T(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_quantity").cast("long") * 10).alias("b"))
    return sequences.span_cover(spans, "l_orderkey", "a", "b")


def _intervals(spark, d):
    w = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    l = T(spark, d, "lineitem").withColumn("before", F.lag("l_shipdate").over(w))
    return l.groupBy("l_suppkey").agg(F.sum((F.datediff("l_shipdate", "before") < 3).cast("int")).alias("n_close"))


def _newest(spark, d):
    w = W.partitionBy("source", F.md5("text")).orderBy(F.desc("doc_id"))
    return T(spark, d, "documents").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("source", "doc_id")


def _quartiles(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "source", "n_chars")
    return selection.buckets(docs, "source", "n_chars", "doc_id", 4).select("doc_id", "source", F.col("bucket").alias("quartile"))


def _context(spark, d):
    """Errors with two rows around them, once each."""
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 2)
    e = T(spark, d, "events").withColumn("near", F.max((F.col("event_type") == "error").cast("int")).over(w))
    return e.filter("near = 1").select("user_id", "event_id", "event_type")


def _frames(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return T(spark, d, "orders").select(
        "o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.ntile(4).over(w).alias("part"),
        F.dense_rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rank"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"),
    )


def _closure(spark, d):
    """Customers as a tree: each is the child of the one at half its number; all below the first three."""
    c = T(spark, d, "customer").filter("c_custkey > 1")
    edges = c.select(F.floor(F.col("c_custkey") / 2).alias("parent"), F.col("c_custkey").alias("child"))
    roots = T(spark, d, "customer").filter("c_custkey between 2 and 4").select(F.col("c_custkey").alias("root"))
    return graphs.descendants(edges, roots)


def _packets(spark, d):
    e = T(spark, d, "conversations").select("conv_id", "turn", F.octet_length("text").alias("size"))
    return sequences.packets(e, "conv_id", "turn", "size", 3, 600)


QUERIES = {
    "jon07_next_user": (_following, "SELECT conv_id, turn, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_user FROM conversations"),
    "jon08_answers": (
        lambda spark, d: turns.answers(T(spark, d, "conversations")),
        """
SELECT u.conv_id, u.turn, u.text AS question, a.turn AS answer_turn, a.text AS answer
FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_user FROM conversations WHERE role = 'user') u
JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn
  AND (u.next_user IS NULL OR a.turn < u.next_user)
QUALIFY row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY a.turn DESC) = 1
""",
    ),
    "jon09_turn_arrays": (_turn_arrays, "WITH t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_id FROM conversations) SELECT conv_id, turn_id, coalesce(string_agg(length(text), ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS lengths, count(*) FILTER (WHERE role = 'assistant') AS n_responses FROM t WHERE turn_id > 0 GROUP BY ALL"),
    "win05_episodes": (_episodes, "WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 AND event_type <> 'signup' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM f) SELECT user_id, episode, count(*) n, min(event_id) least, round(sum(value), 2) total FROM g GROUP BY ALL"),
    "win06_repeat_runs": (_repeats, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY user_id, event_type, run HAVING count(*) >= 3"),
    "jon22_call_pairs": (_pairs, "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), m AS (SELECT *, max(CASE WHEN event_type = 'click' THEN n END) OVER w AS call, max(CASE WHEN event_type IN ('purchase', 'signup') THEN n END) OVER w AS clear FROM n WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, CASE WHEN call > coalesce(clear, 0) THEN n - call END AS distance, coalesce(CASE WHEN call > coalesce(clear, 0) THEN n - call END <= 3, false) AS paired FROM m WHERE event_type = 'purchase'"),
    "win08_overlapping_chunks": (_chunks, "SELECT c AS chunk, count(*) n, CAST(sum(CASE WHEN o_orderkey // 500 = c THEN 1 ELSE 0 END) AS BIGINT) n_owned, CAST(sum(o_orderkey) AS BIGINT) total FROM (SELECT o_orderkey, unnest(generate_series(greatest(CAST(floor((o_orderkey - 3) / 500) AS BIGINT), 0), (o_orderkey + 3) // 500)) AS c FROM orders) GROUP BY 1"),
    "agg19_span_cover": (_cover, "WITH s AS (SELECT l_orderkey, l_partkey a, l_partkey + CAST(l_quantity AS BIGINT) * 10 b FROM lineitem), r AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT l_orderkey, CAST(sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS BIGINT) AS covered, CAST(sum(CASE WHEN a > reach THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM r GROUP BY 1"),
    "win12_adjacent": (_intervals, "WITH b AS (SELECT l_suppkey, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS before FROM lineitem) SELECT l_suppkey, CAST(sum(CASE WHEN date_diff('day', CAST(before AS DATE), CAST(l_shipdate AS DATE)) < 3 THEN 1 WHEN before IS NULL THEN NULL ELSE 0 END) AS BIGINT) AS n_close FROM b GROUP BY 1"),
    "win01_newest": (_newest, "SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY source, md5(text)"),
    "win10_quartiles": (_quartiles, "SELECT doc_id, source, CAST(least(3, floor((row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1) * 4 / count(*) OVER (PARTITION BY source))) AS BIGINT) AS quartile FROM documents"),
    "win14_context": (_context, "SELECT user_id, event_id, event_type FROM (SELECT *, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM events) WHERE near = 1"),
    "win15_frames": (_frames, "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, ntile(4) OVER w AS part, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rank, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "jon15_closure": (_closure, "WITH RECURSIVE r AS (SELECT c_custkey AS root, c_custkey AS node, 0 AS depth FROM customer WHERE c_custkey BETWEEN 2 AND 4 UNION ALL SELECT root, c_custkey, depth + 1 FROM r JOIN customer ON c_custkey // 2 = node AND c_custkey > 1) SELECT root, node, depth FROM r"),
    "win07_packets": (_packets, None),
}
