"""Queries of query analysis and evidence tools."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tools
from ..tables import table as T

LEX = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./#-]*')"
DEEP = ["license", "version", "public"]
TIER_TERMS = ("the", "that", "with")


def _identifiers(spark, d):
    got = T(spark, d, "documents").select("doc_id", F.array_sort(tools.identifier_terms(F.col("text"))).alias("t"))
    return got.filter(F.size("t") > 0).select("doc_id", F.array_join("t", " ").alias("terms"))


def _focused(spark, d):
    return T(spark, d, "benchmark").select("item_id", F.array_join(tools.focused_terms(F.concat(F.col("text"), F.lit(" june 7 77 1999"))), " ").alias("terms"))


def _probes(spark, d):
    probes = tools.partial_probes(X.informative_terms(F.col("text")), F.col("item_id") % 2 == 0)
    return T(spark, d, "benchmark").select("item_id", F.explode(probes).alias("p")).select("item_id", "p.query", "p.kind")


def _coordinates(spark, d):
    return T(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in tools.coordinates(F.col("text"), 100, 300).items()])


def _root_ordinals(spark, d):
    """The first three lines of each order, by quantity."""
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey"))
    return T(spark, d, "lineitem").withColumn("ordinal", rank).filter("ordinal <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "ordinal")


def _typed(spark, d):
    e = T(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("kind"), F.get_json_object("props", "$.k").alias("k"), F.when(F.col("event_id") % 3 != 0, F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(""))).alias("user"))
    codes = tools.faults({"kind": "string", "k": "int"}, {"user": "int"}, {"kind": ("click", "view")})
    return e.groupBy(F.array_join(codes, ",").alias("faults")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def _scope(spark, d):
    """Orders as cards: in scope by source, time and state, with why the others are not."""
    o = T(spark, d, "orders")
    why = F.when(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "source").when(~F.col("o_orderdate").between("1995-01-01", "1997-12-31"), "time").when(F.col("o_orderstatus") == "P", "state").otherwise("in")
    return o.groupBy(why.alias("why")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def _ranges(spark, d):
    c = T(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role")
    asked = c.select("conv_id").distinct().select("conv_id", F.lit(3).alias("first"), F.lit(4).alias("last"))
    return tools.open_ranges(c, asked, "conv_id", "turn", 2).select("conv_id", "turn", "role", "core", "place")


def _deep(spark, d):
    return tools.deep_search(T(spark, d, "documents"), "doc_id", "text", DEEP, 25)


def _visible(spark, d):
    """Turns as plain text and as envelopes of five shapes, with blocks, a bare message and a JSON string."""
    t, k = F.col("text"), F.col("turn") % 6
    one = F.to_json(F.struct(F.struct(t.alias("content")).alias("message"), t.alias("text")))
    two = F.to_json(F.struct(F.struct(F.col("role").alias("message")).alias("payload"), t.alias("content")))
    block = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    three = F.to_json(F.struct(F.struct(F.array(block(t), block(F.lit("more")), block(t)).alias("content")).alias("message")))
    four, five = F.to_json(F.struct(t.alias("message"))), F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    shown = tools.visible_text(F.when(k == 0, t).when(k == 1, one).when(k == 2, two).when(k == 3, three).when(k == 4, four).otherwise(five))
    return T(spark, d, "conversations").select("conv_id", "turn", F.md5(shown.cast("binary")).alias("md5"))


def _segments(spark, d):
    s = T(spark, d, "documents").select("doc_id", "text", tools.segments(F.col("text"), 500).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", lambda x: F.octet_length(x))).alias("most"), (F.array_join("s", "") == F.col("text")).alias("whole"))


def _merged(spark, d):
    parts = T(spark, d, "events").groupBy("event_type", "user_id", (F.col("event_id") % 5).alias("part")).agg(F.min("event_id").alias("event_id"))
    out = tools.merge_observed(parts, "event_type", "user_id", "event_id", 20)
    return out.select("event_type", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "omitted")


def _json_merge(spark, d):
    first = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("props").alias("src")))
    nested = F.struct(F.col("event_id").alias("n"), F.array(F.lit(1), F.lit(2)).alias("l"))
    second = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("k"), F.lit("y").alias("z"), nested.alias("deep"))))
    m = F.from_json(tools.merged_json(first, second), "map<string,string>")
    return T(spark, d, "events").select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("merged"))


def _json_types(spark, d):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("1", '"a"', "true", "null", '{"a":1}', "[1]", "1.5")]), (F.col("event_id") % 7 + 1).cast("int"))
    return T(spark, d, "events").groupBy(tools.json_type(raw).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def _vectors(spark, d):
    odd = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 5)).when(F.col("vec_id") % 7 == 0, F.concat(F.slice("embedding", 2, 1000), F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return T(spark, d, "embeddings").select("vec_id", tools.sound_vector(odd, 64).alias("sound"))


def _instants(spark, d):
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00"), zone)
    return T(spark, d, "orders").select("o_orderkey", F.unix_timestamp(tools.utc_instant(said)).alias("s"))


def _tiers(spark, d):
    """Turns as hits: a phrase is tier 2, all terms tier 1, any term tier 0."""
    c = T(spark, d, "conversations").withColumn("low", F.lower("text"))
    has = [F.contains("low", F.lit(t)).cast("int") for t in TIER_TERMS]
    c = c.withColumn("m", sum(has[1:], has[0])).filter("m > 0")
    tier = F.when(F.contains("low", F.lit("of the")), 2).when(F.col("m") == len(TIER_TERMS), 1).otherwise(0)
    return tools.tiered(c.select("conv_id", tier.alias("tier"), F.round(F.col("m") / (1 + F.col("turn") / 180), 8).alias("score"), F.col("m").alias("n_long")), "conv_id", 40)


def _pointers(spark, d):
    """How far clipped texts stand for whole ones, by language: recall of texts with a term, and bytes."""
    t = T(spark, d, "documents").select("lang", F.lower("text").alias("low"), F.lower(X.clip(F.col("text"), 400)).alias("short"))
    has = lambda c: F.contains(c, F.lit("license")).cast("int")
    got = t.groupBy("lang").agg(F.sum(has(F.col("low"))).alias("answers"), F.sum(has(F.col("low")) * has(F.col("short"))).alias("found"), F.sum(F.octet_length("low")).alias("raw"), F.sum(F.octet_length("short")).alias("pointer"))
    return got.select("lang", "answers", F.round(F.when(F.col("answers") > 0, F.col("found") / F.col("answers")).otherwise(1.0), 8).alias("recall"), F.round(F.col("raw") / F.col("pointer"), 6).alias("reduction"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_MONTHS = ", ".join(f"'{m}'" for m in tools.MONTHS)
_INFO = f"SELECT item_id, x, min(i) AS i FROM (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9_./#-]*') AS w FROM benchmark)) WHERE (length(x) > 2 OR regexp_matches(x, '[0-9]')) AND x NOT IN ({_STOP}) GROUP BY ALL"
_COUNTS = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in DEEP)
_HAS = " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in TIER_TERMS)
_SHORT = "CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || chr(10) || '…' || chr(10) || right(text, 200) END"

QUERIES = {
    "str10_identifiers": (_identifiers, f"SELECT doc_id, array_to_string(list_sort(t), ' ') AS terms FROM (SELECT doc_id, list_distinct(list_filter({LEX}, lambda x: (regexp_matches(x, '[0-9]') AND regexp_matches(x, '[-_./#]')) OR regexp_full_match(x, '[0-9a-f]{{8,}}'))) AS t FROM documents) WHERE len(t) > 0"),
    "str11_focused": (_focused, "WITH f AS (" + _INFO.format("text || ' june 7 77 1999'") + f"), k AS (SELECT * FROM f WHERE x NOT IN ({_MONTHS}) AND NOT (regexp_full_match(x, '[0-9]{{1,9}}') AND (TRY_CAST(x AS INT) BETWEEN 1 AND 31 OR TRY_CAST(x AS INT) BETWEEN 1900 AND 2100))), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM k) SELECT item_id, string_agg(x, ' ' ORDER BY i) AS terms FROM r WHERE rn <= 16 GROUP BY 1"),
    "str12_probes": (_probes, "WITH f AS (" + _INFO.format("text") + "), r AS (SELECT *, regexp_matches(x, '[._/-]') AS j, row_number() OVER (PARTITION BY item_id ORDER BY regexp_matches(x, '[._/-]') DESC, regexp_matches(x, '[0-9]') DESC, length(x) DESC, i) AS rn, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM f), c AS (SELECT item_id, first(x ORDER BY length(x) DESC, i) AS x FROM r WHERE j GROUP BY 1) SELECT item_id, string_agg(x, ' ' ORDER BY rn) AS query, 'pair' AS kind FROM r WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2 UNION ALL SELECT item_id, x, 'anchor' FROM c UNION ALL SELECT item_id, x, 'time-anchor' FROM r WHERE place = 1 AND item_id % 2 = 0 AND item_id NOT IN (SELECT item_id FROM c)"),
    "str19_coordinates": (_coordinates, "SELECT doc_id, least(100, length(text)) AS content_start, least(300, length(text)) AS content_end, length(text) AS content_length, strlen(left(text, 100)) AS byte_start, strlen(left(text, 300)) AS byte_end, strlen(text) AS n_bytes, length(text) = 0 AS complete FROM documents"),
    "win02_ordinals": (_root_ordinals, "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS ordinal FROM lineitem QUALIFY ordinal <= 3"),
    "flt12_typed": (_typed, "WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS kind, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 3 <> 0 THEN user_id || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END END AS u FROM events) SELECT concat_ws(',', CASE WHEN kind IS NULL THEN 'missing:kind' END, CASE WHEN k IS NULL THEN 'missing:k' END, CASE WHEN k IS NOT NULL AND TRY_CAST(k AS INT) IS NULL THEN 'type:k' END, CASE WHEN u IS NOT NULL AND TRY_CAST(u AS INT) IS NULL THEN 'type:user' END, CASE WHEN kind NOT IN ('click', 'view') THEN 'enum:kind' END) AS faults, count(*) AS n, min(event_id) AS first FROM e GROUP BY 1"),
    "flt13_scope": (_scope, "SELECT CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 'source' WHEN NOT (o_orderdate BETWEEN '1995-01-01' AND '1997-12-31') THEN 'time' WHEN o_orderstatus = 'P' THEN 'state' ELSE 'in' END AS why, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"),
    "flt16_ranges": (_ranges, "SELECT conv_id, CAST(turn AS INT) AS turn, role, turn BETWEEN 3 AND 4 AS core, row_number() OVER (PARTITION BY conv_id ORDER BY turn BETWEEN 3 AND 4 DESC, turn) AS place FROM conversations WHERE turn BETWEEN 1 AND 6"),
    "udf06_deep_search": (_deep, f"SELECT doc_id, CAST({_COUNTS} AS BIGINT) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE {_COUNTS} > 0 ORDER BY score DESC, doc_id LIMIT 25"),
    "prj04_visible_text": (_visible, "SELECT conv_id, turn, md5(CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' AND turn % 6 = 3 THEN 'more' WHEN turn % 6 = 2 AND role <> text THEN role || chr(10) || text WHEN turn % 6 = 3 AND text <> 'more' THEN text || chr(10) || 'more' ELSE text END) AS md5 FROM conversations"),
    "prj02_segments": (_segments, None),
    "agg26_merged_parts": (_merged, "WITH o AS (SELECT event_type, user_id, min(event_id) AS e FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY e, user_id) AS rn FROM o) SELECT event_type, string_agg(user_id, ',' ORDER BY rn) FILTER (WHERE rn <= 20) AS kept, greatest(count(*) - 20, 0) AS omitted FROM r GROUP BY 1"),
    "jsn03_merge": (_json_merge, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'deep={\"l\":[1,2],\"n\":' || event_id || '},k=' || event_type || ',src=props,z=y' ELSE 'k=' || json_extract_string(props, '$.k') || ',src=props' END AS merged FROM events"),
    "jsn06_types": (_json_types, "SELECT CASE event_id % 7 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'boolean' WHEN 3 THEN 'null' WHEN 4 THEN 'object' WHEN 5 THEN 'array' ELSE 'number' END AS kind, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1"),
    "mth06_sound_vectors": (_vectors, "SELECT vec_id, vec_id % 9 <> 0 AND vec_id % 7 <> 0 AND len(embedding) = 64 AS sound FROM embeddings"),
    "dte03_instants": (_instants, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) + 36000 WHEN 1 THEN CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) + 28800 END AS s FROM orders"),
    "top04_tiers": (_tiers, f"WITH h AS (SELECT conv_id, turn, t, {_HAS} AS m FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)), s AS (SELECT conv_id, CASE WHEN contains(t, 'of the') THEN 2 WHEN m = 3 THEN 1 ELSE 0 END AS tier, round(m / (1 + turn / 180), 8) AS score, m AS n_long FROM h WHERE m > 0), b AS (SELECT conv_id, max(struct_pack(tier := tier, score := score, n_long := n_long)) AS b, count(*) AS n FROM s GROUP BY 1) SELECT conv_id, b.tier AS tier, round(b.score + 0.2 * ln(1 + n), 8) AS score FROM b WHERE b.tier > 0 OR b.n_long >= 2 ORDER BY tier DESC, score DESC, conv_id LIMIT 40"),
    "aud07_pointers": (_pointers, f"WITH t AS (SELECT lang, lower(text) AS low, lower({_SHORT}) AS short FROM documents) SELECT lang, CAST(sum(CAST(contains(low, 'license') AS INT)) AS BIGINT) AS answers, round(CASE WHEN sum(CAST(contains(low, 'license') AS INT)) > 0 THEN sum(CAST(contains(low, 'license') AND contains(short, 'license') AS INT)) / sum(CAST(contains(low, 'license') AS INT)) ELSE 1.0 END, 8) AS recall, round(sum(strlen(low)) / sum(strlen(short)), 6) AS reduction FROM t GROUP BY 1"),
}
