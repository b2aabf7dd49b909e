"""Queries of ingest and derived data, over a log made from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, queues
from ..tables import table as T


def _log(spark, d):
    """Events as revisions: a user's event type is the key, the tens of the value the content."""
    return T(spark, d, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("native_id"), F.floor(F.col("value") / 10).cast("string").alias("content"), F.col("event_id").alias("arrival"),
        F.col("ts").alias("occurred_at"), (F.col("event_type") == "error").alias("is_tombstone"),
        F.when(F.col("event_type") == "click", "view").when(F.col("event_type") == "view", "error").alias("parent"),
    )


def _revisions(spark, d):
    return ingest.new_revisions(None, _log(spark, d)).select("source", "native_id", "content", "arrival", "revision")


def _incremental(spark, d):
    """The same in two batches: the second against the log of the first."""
    log = _log(spark, d)
    half = F.col("arrival") < 5000
    first = ingest.new_revisions(None, log.filter(half))
    second = ingest.new_revisions(first, log.filter(~half))
    return first.unionByName(second).select("source", "native_id", "content", "arrival", "revision")


def _live(spark, d):
    return ingest.live(ingest.new_revisions(None, _log(spark, d).filter("occurred_at >= '2024-01-20' or native_id != 'error'"))).select("source", "native_id", "revision")


def _dirty(spark, d):
    o = T(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ingest.dirty_months(o, "a", "b")


def _reuse(spark, d):
    docs = T(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("embedded")).filter("embedded < 300")
    kept, rest = ingest.reuse(docs, first, "digest")
    return kept.select("doc_id", "embedded").unionByName(rest.select("doc_id", F.lit(None).cast("long").alias("embedded")))


def _schedule(spark, d):
    e = T(spark, d, "events")
    outcome = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "rate_limited").when(F.col("event_type") == "error", "transient").otherwise("fatal")
    lit = lambda x: F.lit(float(x))
    due = queues.next_due(F.col("event_id").cast("double"), outcome, F.col("user_id") % 9 + 1, lit(60), lit(3), lit(5), lit(600), F.col("value"))
    return e.select("event_id", F.round(due, 6).alias("due"))


def _claim(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderkey") % 50 == 0, "processing").otherwise("delivered").alias("state"))
    return queues.claimable(o, "o_custkey", "o_orderkey", "state").select("o_custkey", "o_orderkey")


def _route(spark, d):
    e = T(spark, d, "events")
    bit = lambda n, k: F.pmod(F.floor(F.col("event_id") / n), F.lit(k)) == 0
    rules = {
        "is_message": ~bit(1, 13), "mentions_others": bit(2, 5), "mentions_self": bit(3, 3), "bot": bit(5, 4), "trusted": bit(7, 2), "allowed_human": ~bit(11, 6), "allowed_channel": ~bit(13, 7),
        "direct": bit(17, 8), "bound": bit(19, 3), "addressed": bit(23, 2), "admitted": bit(29, 2), "native": bit(31, 2), "lease": bit(37, 9),
    }
    return e.select("event_id", queues.route(rules).alias("target"))


def _facts(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "started", "click", "tool", "view", "message", "purchase", "completed", "error", "error")])
    e = T(spark, d, "events").select("user_id", "event_id", kind[F.col("event_type")].alias("kind"), F.col("props").alias("said"))
    return queues.run_facts(e, "user_id", "event_id", "kind", "said")


def _bins(spark, d):
    p = queues.lightest_bins(T(spark, d, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice", 8)
    return p.groupBy("o_orderpriority", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("size"))


_LOG = """SELECT CAST(user_id AS VARCHAR) AS source, event_type AS native_id, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS content, event_id AS arrival, ts AS occurred_at, event_type = 'error' AS is_tombstone FROM events"""
_REV = f"WITH f AS (SELECT source, native_id, content, min(arrival) AS arrival FROM ({_LOG}{{}}) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY source, native_id ORDER BY arrival) AS revision FROM f"

QUERIES = {
    "stm02_revisions": (_revisions, _REV.format("")),
    "stm02_incremental": (_incremental, _REV.format("")),
    "stm03_live": (_live, f"WITH r AS ({_REV.format(' WHERE ts >= TIMESTAMP ' + chr(39) + '2024-01-20' + chr(39) + ' OR event_type <> ' + chr(39) + 'error' + chr(39))}), c AS (SELECT source, native_id, max(revision) AS revision FROM r GROUP BY ALL), t AS (SELECT source FROM c WHERE native_id = 'error'), v AS (SELECT source FROM c WHERE native_id = 'view' AND source IN (SELECT source FROM t)) SELECT source, native_id, revision FROM c WHERE native_id <> 'error' AND NOT (native_id = 'view' AND source IN (SELECT source FROM t)) AND NOT (native_id = 'click' AND source IN (SELECT source FROM v))"),
    "stm05_dirty_months": (_dirty, "WITH s AS (SELECT o_orderpriority AS source, o_custkey, date_trunc('month', min(o_orderdate)) a, date_trunc('month', max(o_orderdate)) b FROM orders GROUP BY ALL) SELECT source, CAST(bucket AS DATE) AS bucket, count(*) AS generation FROM (SELECT source, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS bucket FROM s) GROUP BY ALL"),
    "stm15_reuse": (_reuse, "WITH f AS (SELECT md5(text) AS g, min(doc_id) AS m FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN m < 300 THEN m END AS embedded FROM documents JOIN f ON md5(text) = g"),
    "stm16_schedule": (_schedule, "SELECT event_id, round(event_id + CASE event_type WHEN 'click' THEN 63.0 WHEN 'view' THEN least(600.0, value + 3) WHEN 'error' THEN least(600.0, 5.0 * pow(2.0, least(user_id % 9, 30))) + 3 END, 6) AS due FROM events"),
    "stm17_claim": (_claim, "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 50 = 0) GROUP BY 1"),
    "stm19_routing": (
        _route,
        """
WITH r AS (SELECT event_id AS e, event_id % 13 <> 0 AS msg, (event_id // 2) % 5 = 0 AS oth, (event_id // 3) % 3 = 0 AS self, (event_id // 5) % 4 = 0 AS bot, (event_id // 7) % 2 = 0 AS tru,
 (event_id // 11) % 6 <> 0 AS hum, (event_id // 13) % 7 <> 0 AS cha, (event_id // 17) % 8 = 0 AS dm, (event_id // 19) % 3 = 0 AS bnd, (event_id // 23) % 2 = 0 AS adr, (event_id // 29) % 2 = 0 AS adm,
 (event_id // 31) % 2 = 0 AS nat, (event_id // 37) % 9 = 0 AS lea FROM events)
SELECT e AS event_id, CASE WHEN NOT msg THEN 'silent' WHEN oth AND NOT self THEN 'silent' WHEN bot AND NOT tru THEN 'silent' WHEN bot AND NOT self THEN 'silent' WHEN NOT bot AND NOT hum THEN 'silent'
 WHEN NOT cha AND NOT dm THEN 'silent' WHEN bnd AND adr AND NOT adm THEN 'silent' WHEN bnd AND adr AND nat THEN 'native' WHEN bnd AND adr THEN 'assistant' WHEN bnd THEN 'silent'
 WHEN self OR dm OR lea THEN 'assistant' ELSE 'silent' END AS target FROM r
""",
    ),
    "agg23_run_facts": (_facts, "SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS turns, count(*) FILTER (WHERE event_type = 'click') AS tool_calls, arg_max(props, event_id) FILTER (WHERE event_type = 'view') AS last_message, arg_max(CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'complete' ELSE 'error' END, event_id) FILTER (WHERE event_type IN ('signup', 'purchase', 'error')) AS phase FROM events GROUP BY 1"),
    "top23_bins": (_bins, None),
}
