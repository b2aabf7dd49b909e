"""Queries that project, validate, rank and summarise evidence."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters, ranking, search, vectors
from ..tables import table as T

# Questions and what they mean on 2024-01-31 12:00.
QUESTIONS = ("what broke yesterday", "errors of today", "all of the last 3 days", "last 48 hours please", "in the LAST 2 weeks", "anything at all", "last 9999 hours")
NOW = "2024-01-31 12:00:00"


def _relative(spark, d):
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, q string")
    since, until = filters.relative_window(F.col("q"), F.lit(NOW).cast("timestamp_ntz"))
    e = T(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    asked = F.broadcast(q.select("id", since.alias("since"), until.alias("until")).filter("since is not null"))  # a fixed list
    return e.join(asked, (F.col("ts") >= F.col("since")) & (F.col("ts") <= F.col("until"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


def _validated(spark, d):
    """The first rule that an event breaks, or ok."""
    code = (
        F.when(F.col("event_id").isNull(), "id").when(~F.col("event_type").isin("click", "purchase", "signup", "view"), "type").when(F.col("value") < 5, "range")
        .when(~F.col("props").rlike(r"^\{.*\}$"), "props").when(F.get_json_object("props", "$.k").cast("long") > 90, "key").otherwise("ok")
    )
    return T(spark, d, "events").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def _items(spark, d):
    """Turns as items: a surface, a receipt, and text with a mark of its role."""
    role = F.col("role")
    surface = F.when(role.isin("user", "assistant"), role).otherwise("note")
    receipt = F.concat(F.lit("lode://conversations/"), F.col("conv_id").cast("string"), F.lit("?rev=1#item="), F.col("turn").cast("string"))
    return T(spark, d, "conversations").select(surface.alias("surface"), receipt.alias("receipt"), F.concat_ws(": ", role, "text").alias("text"))


def _visible(spark, d):
    """Messages of each conversation joined in order, system turns left out."""
    c = T(spark, d, "conversations").filter(~F.col("role").isin("system"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return c.groupBy("conv_id").agg(F.md5(joined.cast("binary")).alias("md5"), F.count(F.lit(1)).alias("n"))


def _actor_columns(spark, d):
    """Distinct sorted triples as three arrays side by side."""
    l, s = T(spark, d, "lineitem"), T(spark, d, "supplier")
    triple = F.struct(F.col("l_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("l_returnflag").alias("relation"))
    got = l.join(s, l.l_suppkey == s.s_suppkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(triple)).alias("a"))
    each = lambda f: F.array_join(F.transform("a", lambda x: x[f].cast("string")), ",")
    return got.select("l_orderkey", each("id").alias("ids"), each("name").alias("names"), each("relation").alias("relations"))


def _latest(spark, d):
    o = T(spark, d, "orders")
    row = F.struct("o_orderdate", "o_orderkey", "o_orderstatus")
    return o.groupBy("o_custkey").agg(F.max_by(row, row).alias("r")).select("o_custkey", "r.o_orderkey", "r.o_orderstatus")


def _parameters(spark, d):
    """A list of asked keys with its order, by a join."""
    asked = spark.createDataFrame([(k, (k * 37) % 500 + 1) for k in range(40)], "place int, key long")
    o = T(spark, d, "orders")
    return o.join(F.broadcast(asked), o.o_custkey == asked.key).groupBy("place", "key").agg(F.count(F.lit(1)).alias("n"))


def _filtered_join(spark, d):
    """Records with their actors in a span of time: rows and distinct actors."""
    o, l = T(spark, d, "orders"), T(spark, d, "lineitem")
    recent = o.filter("o_orderdate >= '1996-06-01' and o_orderdate < '1996-09-01'")
    met = recent.join(l, recent.o_orderkey == l.l_orderkey, "left")
    return met.groupBy("o_orderstatus").agg(F.count("l_orderkey").alias("n"), F.count_distinct("l_suppkey").alias("n_actors"))


def _type_counts(spark, d):
    per = T(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("counts"))


def _merged(spark, d):
    """Spans and the last value of each key, over resumed runs."""
    e = T(spark, d, "events")
    return e.groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.max_by("event_type", "event_id").alias("state"), F.round(F.max("value"), 6).alias("tightest"), F.round(F.sum("value"), 2).alias("usage"))


def _complete(spark, d):
    o = T(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.every(F.col("o_totalprice") > 0).alias("complete"), F.count_distinct("o_custkey").alias("n_unique"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("passed"), F.count(F.lit(1)).alias("total"))


def _people(spark, d):
    """Nations with their suppliers as a nested list."""
    s, n = T(spark, d, "supplier"), T(spark, d, "nation")
    item = F.struct("s_suppkey", "s_name")
    got = n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.sort_array(F.collect_list(F.when(F.col("s_suppkey").isNotNull(), item))).alias("l"))
    return got.select("n_name", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["s_suppkey"].cast("string"), x["s_name"])), ",").alias("sources"))


def _legs(spark, d):
    """Three legs over documents, merged by the least score."""
    docs = T(spark, d, "documents").select("doc_id", F.lower("text").alias("t"), "n_chars")
    a = docs.filter("contains(t, 'licensed under')").select("doc_id", F.lit("phrase").alias("leg"), F.lit(-25.0).alias("bm"))
    b = docs.filter("contains(t, 'license')").select("doc_id", F.lit("term").alias("leg"), (-F.col("n_chars") % 7).cast("double").alias("bm"))
    c = docs.filter("n_chars > 3000").select("doc_id", F.lit("long").alias("leg"), F.lit(0.0).alias("bm"))
    return ranking.merge_legs(a.union(b).union(c), "doc_id", "bm").select("doc_id", "bm", F.array_join("legs", ",").alias("legs"))


def _local_scores(spark, d):
    c = T(spark, d, "conversations")
    score = ranking.local_score(-(F.length("text") % 10) / 2.0, F.col("role"), F.contains(F.col("text"), F.lit("the")), (F.col("turn") * 30).cast("double"))
    return c.select("conv_id", "turn", F.round(score, 8).alias("score"))


def _classes(spark, d):
    """Event types as classes of evidence, the best row of each user."""
    e = T(spark, d, "events")
    m = F.create_map(*[F.lit(x) for x in ("click", "answer", "purchase", "exact-answer", "signup", "identifier", "view", "pair", "error", "other")])
    p = ranking.evidence_priority(m[F.col("event_type")])
    best = F.max(F.struct(p.alias("p"), F.round("value", 6).alias("value"), "event_id")).alias("b")
    return e.filter("value < 60").groupBy("user_id").agg(best).select("user_id", F.col("b.p").alias("priority"), "b.event_id")


def _covers(spark, d):
    docs = T(spark, d, "documents")
    rank = ranking.cover_density(F.col("text"), ["the", "that"])
    return docs.select("doc_id", F.round(rank, 8).alias("rank")).filter("rank > 0").orderBy(F.desc("rank"), "doc_id").limit(50)


def _forms(spark, d):
    docs = T(spark, d, "documents")
    forms = {f: ranking.matches_query(F.col("text"), ["licensed", "under"], f) for f in ("plain", "web", "phrase")}
    return docs.select(*[c.cast("int").alias(f) for f, c in forms.items()]).groupBy("plain", "web", "phrase").agg(F.count(F.lit(1)).alias("n"))


def _rounds(spark, d):
    return ranking.rounds(T(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


def _fair(spark, d):
    o = T(spark, d, "orders").select("o_custkey", "o_orderkey")
    return ranking.fair_turn(o, "o_custkey", "o_orderkey", F.pmod(F.col("o_custkey") * 991, F.lit(15000)))


def _parent_scoped(spark, d):
    """Turns by how many of the asked terms they hold, the best three of each conversation."""
    asked = F.array(*[F.lit(t) for t in ("the", "of", "and", "in")])
    c = T(spark, d, "conversations").withColumn("n", F.size(F.array_intersect(search.lexemes(F.col("text")), asked)))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("n"), "turn"))
    return c.filter("n > 0").withColumn("rank", rank).filter("rank <= 3").select("conv_id", "turn", "n", "rank")


def _closest(spark, d):
    """The three rows nearest to the fifth of each conversation."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.abs(F.col("turn") - 4), "turn"))
    return T(spark, d, "conversations").withColumn("rank", rank).filter("rank <= 3").select("conv_id", "turn", "rank")


def _approximate(spark, d):
    """Neighbours of every fiftieth vector by an inverted file of all rows."""
    v = T(spark, d, "embeddings")
    return vectors.approximate(v.filter("vec_id % 50 = 0"), v, "vec_id", "embedding", 10).drop("place")


def _reset_minutes(spark, d):
    o = T(spark, d, "orders")
    left = F.unix_timestamp(F.lit("1998-01-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    seconds = F.greatest(F.lit(0), left)
    label = F.when(seconds % 86400 == 0, F.concat((seconds / 86400).cast("long").cast("string"), F.lit("d"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))
    return o.select("o_orderkey", F.round(seconds / 60).cast("long").alias("minutes"), label.alias("label"), (F.col("o_totalprice").cast("decimal(18,2)") / 100).cast("decimal(18,4)").cast("double").alias("major"))


_WIN = " UNION ALL ".join(
    f"SELECT {k} AS id, {s} AS since, {u} AS until"
    for k, s, u in (
        (0, "TIMESTAMP '2024-01-30 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"), (1, "TIMESTAMP '2024-01-31 00:00:00'", f"TIMESTAMP '{NOW}'"), (2, "TIMESTAMP '2024-01-28 12:00:00'", f"TIMESTAMP '{NOW}'"),
        (3, "TIMESTAMP '2024-01-29 12:00:00'", f"TIMESTAMP '{NOW}'"), (4, "TIMESTAMP '2024-01-17 12:00:00'", f"TIMESTAMP '{NOW}'"), (6, "TIMESTAMP '2024-01-16 07:00:00'", f"TIMESTAMP '{NOW}'"),
    )
)

QUERIES = {
    "flt07_relative_time": (_relative, f"SELECT id, count(*) AS n, min(event_id) AS least FROM ({_WIN}) JOIN events ON ts BETWEEN since AND until GROUP BY 1"),
    "flt11_validation": (_validated, "SELECT CASE WHEN event_id IS NULL THEN 'id' WHEN event_type NOT IN ('click', 'purchase', 'signup', 'view') THEN 'type' WHEN value < 5 THEN 'range' WHEN NOT regexp_matches(props, '^\\{.*\\}$') THEN 'props' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 90 THEN 'key' ELSE 'ok' END AS code, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1"),
    "prj01_items": (_items, "SELECT CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'note' END AS surface, 'lode://conversations/' || conv_id || '?rev=1#item=' || turn AS receipt, role || ': ' || text AS text FROM conversations"),
    "prj03_visible": (_visible, "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS md5, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1"),
    "prj06_actor_columns": (_actor_columns, "SELECT l_orderkey, string_agg(l_suppkey, ',' ORDER BY l_suppkey, s_name, l_returnflag) AS ids, string_agg(s_name, ',' ORDER BY l_suppkey, s_name, l_returnflag) AS names, string_agg(l_returnflag, ',' ORDER BY l_suppkey, s_name, l_returnflag) AS relations FROM (SELECT DISTINCT l_orderkey, l_suppkey, s_name, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1"),
    "jon10_latest": (_latest, "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "jon17_parameters": (_parameters, "SELECT CAST(place AS INT) AS place, (place * 37) % 500 + 1 AS key, count(*) AS n FROM range(40) t(place) JOIN orders ON o_custkey = (place * 37) % 500 + 1 GROUP BY ALL"),
    "jon18_filtered_join": (_filtered_join, "SELECT o_orderstatus, count(l_orderkey) AS n, count(DISTINCT l_suppkey) AS n_actors FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= '1996-06-01' AND o_orderdate < '1996-09-01' GROUP BY 1"),
    "agg11_merged_spans": (_merged, "SELECT user_id, min(event_id) AS first, max(event_id) AS last, arg_max(event_type, event_id) AS state, round(max(value), 6) AS tightest, round(sum(value), 2) AS usage FROM events GROUP BY 1"),
    "agg22_type_counts": (_type_counts, "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1"),
    "agg30_complete": (_complete, "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS complete, count(DISTINCT o_custkey) AS n_unique, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed, count(*) AS total FROM orders GROUP BY 1"),
    "agg31_people": (_people, "SELECT n_name, count(s_suppkey) AS n, coalesce(string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey), '') AS sources FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1"),
    "top02_merged_legs": (_legs, "WITH l AS (SELECT doc_id, 'phrase' AS leg, -25.0 AS bm FROM documents WHERE contains(lower(text), 'licensed under') UNION ALL SELECT doc_id, 'term', CAST(-n_chars % 7 AS DOUBLE) FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 'long', 0.0 FROM documents WHERE n_chars > 3000) SELECT doc_id, CAST(min(bm) AS DOUBLE) AS bm, string_agg(DISTINCT leg, ',' ORDER BY leg) AS legs FROM l GROUP BY 1"),
    "top03_local_score": (_local_scores, "SELECT conv_id, turn, round((greatest(0.01, 1 + (length(text) % 10) / 2.0) * CASE role WHEN 'user' THEN 4.0 WHEN 'assistant' THEN 2.0 ELSE 1.0 END + CASE WHEN contains(text, 'the') THEN 10.0 ELSE 0.0 END) / (1 + turn * 30 / 180), 8) AS score FROM conversations"),
    "top12_evidence_class": (_classes, "WITH p AS (SELECT *, CASE event_type WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'view' THEN 1 ELSE 0 END AS priority FROM events WHERE value < 60) SELECT user_id, priority, event_id FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, round(value, 6) DESC, event_id DESC) = 1"),
    "top05_cover_density": (_covers, None),
    "str13_query_forms": (_forms, "WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./#-]*') AS w FROM documents), f AS (SELECT list_contains(w, 'licensed') AS a, list_contains(w, 'under') AS b, contains(' ' || array_to_string(w, ' ') || ' ', ' licensed under ') AS c FROM w) SELECT CAST(a AND b AS INT) AS plain, CAST(a OR b AS INT) AS web, CAST(c AS INT) AS phrase, count(*) AS n FROM f GROUP BY ALL"),
    "top21_rounds": (_rounds, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8"),
    "top24_fair_turn": (_fair, "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey > (o_custkey * 991) % 15000 THEN 0 ELSE 1 END, o_orderkey) = 1"),
    "top19_parent_scoped": (_parent_scoped, "WITH n AS (SELECT conv_id, turn, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./#-]*')), ['the', 'of', 'and', 'in'])) AS n FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) AS rank FROM n WHERE n > 0) SELECT conv_id, turn, n, rank FROM r WHERE rank <= 3"),
    "top20_closest": (_closest, "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY abs(turn - 4), turn) AS rank FROM conversations QUALIFY rank <= 3"),
    "top11_approximate": (_approximate, None),
    "dte05_reset": (_reset_minutes, "WITH s AS (SELECT o_orderkey, o_totalprice, greatest(0, CAST(epoch(TIMESTAMP '1998-01-01') - floor(epoch(o_orderdate)) AS BIGINT)) AS s FROM orders) SELECT o_orderkey, CAST(round(s / 60) AS BIGINT) AS minutes, CASE WHEN s % 86400 = 0 THEN (s // 86400) || 'd' ELSE (s // 3600) || 'h' END AS label, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) / 100 AS DECIMAL(18,4)) AS DOUBLE) AS major FROM s"),
}
