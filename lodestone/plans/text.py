"""Queries over texts: redaction, entities, scans, keys, JSON, arrays, time and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redaction as R
from ..functions import text as X
from ..operators import scanning
from ..tables import table as T


def _redacted(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(X.redact(F.col("text")).cast("binary")).alias("md5"))


def _secretless(spark, d):
    """Whole texts without secrets, by line and to a fixpoint."""
    clean = T(spark, d, "documents").select("doc_id", R.public_text(F.col("text")).alias("value"))
    return clean.select("doc_id", F.md5(F.col("value").cast("binary")).alias("md5"), F.length("value").alias("n_chars"))


def _policy(spark, d):
    """The privacy policy's decision on each whole text, with its spans by category."""
    decided = T(spark, d, "documents").select("doc_id", R.policy(F.col("text")).alias("p"))
    tally = F.array_join(F.transform("p.categories", lambda c: F.concat_ws("=", c["category"], c["n"])), ",")
    return decided.select("doc_id", "p.action", "p.reason", tally.alias("categories"), F.md5(F.col("p.value").cast("binary")).alias("md5"))


def _entities(spark, d):
    e = T(spark, d, "documents").select("doc_id", F.explode(X.entities(F.col("text"))).alias("e"))
    return e.select("doc_id", "e.kind", "e.value")


def _terms(spark, d):
    return T(spark, d, "benchmark").select("item_id", F.array_join(X.informative_terms(F.col("text")), " ").alias("terms"))


def _evidence(spark, d):
    """Texts that differ only by case and white space, and in how many sources they stand."""
    k = T(spark, d, "documents").groupBy(F.md5(X.evidence_key(F.col("text")).cast("binary")).alias("key"))
    return k.agg(F.count_distinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def _clip(spark, d):
    t = F.col("text")
    return T(spark, d, "documents").select("doc_id", F.md5(X.clip(t, 400).cast("binary")).alias("md5"), F.octet_length("text").alias("n_bytes"))


def _window(spark, d):
    docs = T(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("license")))
    return docs.select("doc_id", X.content_window(F.col("text"), "license", 60).alias("excerpt"))


def _html(spark, d):
    return T(spark, d, "pages").select("page_id", X.html_text(F.col("html")).alias("text"), X.basename(F.regexp_replace("url", "[?#].*$", "")).alias("label"))


def _literal(spark, d):
    return scanning.literal_scan(T(spark, d, "documents"), "text", ["License", "password", "copyright"]).select("doc_id", F.array_join("matched", ",").alias("matched"))


def _pattern(spark, d):
    return scanning.pattern_scan(T(spark, d, "conversations"), "conv_id", "turn", "text", "[0-9]{3}", 1).select("conv_id", "turn", "hit")


def _page(spark, d):
    return scanning.byte_page(T(spark, d, "conversations"), "conv_id", "turn", "text", 300).select("conv_id", "turn")


def _json(spark, d):
    props = F.col("props")
    return T(spark, d, "events").select(
        "event_id", F.get_json_object(props, "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"), F.get_json_object(props, "$.none").alias("none"))).alias("packed"),
    )


def _digests(spark, d):
    c = T(spark, d, "customer")
    return c.select("c_custkey", X.opaque_id("cus", F.col("c_name"), F.col("c_nationkey").cast("string")).alias("id"), F.pmod(F.crc32(F.col("c_name").cast("binary")), F.lit(8)).alias("shard"))


def _document_digest(spark, d):
    c = T(spark, d, "conversations")
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return c.groupBy("conv_id").agg(F.sha2(ordered.cast("binary"), 256).alias("sha256"))


def _roles(spark, d):
    c = T(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    both = F.size(F.array_except(F.array(F.lit("user"), F.lit("assistant")), F.col("roles"))) == 0
    return c.select("conv_id", F.array_join("roles", ",").alias("roles"), both.alias("complete"), F.size("roles").alias("n"))


def _times(spark, d):
    o = F.col("o_orderdate")
    return T(spark, d, "orders").select(
        "o_orderkey", F.trunc(o, "month").alias("bucket"), F.add_months(F.trunc(o, "month"), 1).alias("next_bucket"), F.unix_micros(o.cast("timestamp")).alias("us"),
        F.greatest(F.lit(0), F.datediff(F.lit("1998-01-01").cast("date"), o)).alias("days_left"),
    )


def _backoff(spark, d):
    n = F.col("l_linenumber")
    return T(spark, d, "lineitem").select("l_linenumber").distinct().select("l_linenumber", F.least(F.lit(60.0), 5.0 * F.pow(F.lit(2.0), n - 1)).alias("seconds"))


def _luhn(spark, d):
    found = T(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{16}\b"), F.lit(0))).alias("number")).distinct()
    return found.withColumn("valid", F.expr("luhn_check(number)"))


_LUHN = " + ".join(f"CASE WHEN {k} % 2 = 0 THEN (2 * CAST(number[{k + 1}] AS INT)) // 10 + (2 * CAST(number[{k + 1}] AS INT)) % 10 ELSE CAST(number[{k + 1}] AS INT) END" for k in range(16))


def _nested(template: str, start: str, parts) -> str:
    for a, b in parts:
        start = template.format(start, a.replace("'", "''"), b)
    return start


_REDACT = _nested("regexp_replace({}, '{}', '{}', 'g')", "text", [(p, f"[REDACTED:{k}]") for k, p in X.REDACTIONS])
_ENT = " UNION ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}')) AS value FROM documents" for k, p in X.ENTITIES)
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)

QUERIES = {
    "str01_redact": (_redacted, f"SELECT doc_id, md5({_REDACT}) AS md5 FROM documents"),
    "str01_fixpoint": (_secretless, None),
    "str03_policy": (_policy, None),
    "str04_luhn": (_luhn, f"SELECT doc_id, number, ({_LUHN}) % 10 = 0 AS valid FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{{16}}\\b')) AS number FROM documents)"),
    "str07_entities": (_entities, _ENT),
    "str08_terms": (_terms, f"WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_./#-]*') AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), f AS (SELECT item_id, x, min(i) AS i FROM u WHERE (length(x) > 2 OR regexp_matches(x, '[0-9]')) AND x NOT IN ({_STOP}) GROUP BY ALL) SELECT item_id, string_agg(x, ' ' ORDER BY i) AS terms FROM f GROUP BY 1"),
    "str14_evidence": (_evidence, "SELECT md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, count(DISTINCT source) n_sources, count(*) n FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "str16_clip": (_clip, "SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || chr(10) || '…' || chr(10) || right(text, 200) END) AS md5, strlen(text) AS n_bytes FROM documents"),
    "str18_window": (_window, "SELECT doc_id, substring(text, greatest(instr(lower(text), 'license') - 30, 1), 60) AS excerpt FROM documents WHERE lower(text) LIKE '%license%'"),
    "str21_html": (_html, None),
    "flt14_literal_scan": (_literal, "SELECT doc_id, concat_ws(',', CASE WHEN text ILIKE '%license%' THEN 'License' END, CASE WHEN text ILIKE '%password%' THEN 'password' END, CASE WHEN text ILIKE '%copyright%' THEN 'copyright' END) AS matched FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%password%' OR text ILIKE '%copyright%'"),
    "flt15_pattern_scan": (_pattern, "SELECT conv_id, turn, hit FROM (SELECT conv_id, turn, regexp_matches(text, '[0-9]{3}') AS hit, max(CAST(regexp_matches(text, '[0-9]{3}') AS INT)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM conversations) WHERE near = 1"),
    "flt17_byte_page": (_page, "SELECT conv_id, turn FROM (SELECT conv_id, turn, strlen(text) AS n, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before = 0 OR before + n <= 300"),
    "jsn01_paths": (_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"t\":\"' || event_type || '\"}' AS packed FROM events"),
    "hsh01_ids": (_digests, None),
    "agg29_digest": (_document_digest, "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256 FROM conversations GROUP BY 1"),
    "arr03_roles": (_roles, "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant')) = 2 AS complete, count(DISTINCT role) AS n FROM conversations GROUP BY 1"),
    "dte02_months": (_times, "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS bucket, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_bucket, epoch_us(o_orderdate) AS us, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01')) AS days_left FROM orders"),
    "mth05_backoff": (_backoff, "SELECT DISTINCT l_linenumber, least(60.0, 5.0 * pow(2.0, l_linenumber - 1)) AS seconds FROM lineitem"),
}
