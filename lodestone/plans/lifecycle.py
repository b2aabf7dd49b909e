"""Queries of captures, edits, budgets and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..tables import table as T


def _captures(spark, d):
    c = T(spark, d, "conversations")
    raw = F.to_json(F.struct(F.col("role").alias("title"), F.when(F.col("turn") % 7 != 0, F.col("text")).alias("body"), F.when(F.col("turn") % 5 != 0, F.lit("2024-01-01T00:00:00Z")).otherwise(F.lit("soon")).alias("occurred_at"), F.array(F.lit("b"), F.lit("a")).alias("tags")))
    out = lifecycle.capture_envelopes(c.withColumn("raw", raw), "raw", F.lit("me"))
    return out.groupBy(F.coalesce("fault", F.lit("ok")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


def _settled(spark, d):
    e = T(spark, d, "events").select("user_id", F.col("event_id"), F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "edit").otherwise("post").alias("kind"), F.col("props").alias("said"), (F.col("event_id") % 3).alias("thread"))
    return lifecycle.settled(e, ["user_id", "thread"], "event_id", "kind", "said")


def _budget(spark, d):
    return lifecycle.within_budget(T(spark, d, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "allowed")


def _relations(spark, d):
    """Every customer from two roots, the customer of half a number being its parent."""
    c = T(spark, d, "customer")
    edges = c.filter("c_custkey > 1").select(F.floor(F.col("c_custkey") / 2).alias("parent"), F.col("c_custkey").alias("child"))
    return lifecycle.relations(edges, c.filter("c_custkey in (9, 40)").select(F.col("c_custkey").alias("root")))


def _disagreements(spark, d):
    o = T(spark, d, "orders")
    now = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("revision"))
    then = o.filter("o_orderdate < '1998-06-01'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("revision"))
    return lifecycle.disagreements(then, now, "o_custkey", "revision")


QUERIES = {
    "src28_captures": (_captures, "SELECT CASE WHEN turn % 7 = 0 THEN 'body' WHEN turn % 5 = 0 THEN 'occurred_at' ELSE 'ok' END AS fault, count(*) AS n FROM conversations GROUP BY 1"),
    "stm21_settled": (_settled, "WITH k AS (SELECT *, event_id % 3 AS thread FROM events) SELECT user_id, thread, arg_max(props, event_id) FILTER (WHERE event_type <> 'error') AS text, count(*) AS n_changes FROM k GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'error'"),
    "stm22_budget": (_budget, "SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 1 AS allowed FROM events"),
    "jon16_relations": (_relations, "WITH RECURSIVE up AS (SELECT c_custkey AS k, c_custkey AS a, 0 AS d FROM customer UNION ALL SELECT k, a // 2, d + 1 FROM up WHERE a > 1) SELECT r.k AS root, n.k AS node, min(r.d + n.d) AS depth FROM up r JOIN up n ON r.a = n.a WHERE r.k IN (9, 40) GROUP BY ALL"),
    "aud06_agreement": (_disagreements, "SELECT coalesce(a.k, b.k) AS o_custkey, a.n AS at_boundary, b.n AS stored FROM (SELECT o_custkey k, count(*) n FROM orders WHERE o_orderdate < '1998-06-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey k, count(*) n FROM orders GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n"),
}
