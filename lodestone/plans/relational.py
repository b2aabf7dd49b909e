"""Filters, joins, aggregates and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import filters, selection
from ..tables import table as T


def _orders_filtered(spark, d):
    out = filters.read_filters(
        T(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"),
        {"since": "1995-01-01", "until": "1996-12-31", "source_id": ["F", "O"], "contains": "URGENT"},
        {"since": "o_orderdate", "until": "o_orderdate", "source_id": "o_orderstatus", "contains": "o_orderpriority"},
    )
    return out.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _customers_by_sources(spark, d):
    """Sources: in a named region, of a segment, with orders: successive semi joins."""
    c, n, r = (T(spark, d, t) for t in ("customer", "nation", "region"))
    named = n.join(r.filter("r_name in ('EUROPE', 'ASIA')"), n.n_regionkey == r.r_regionkey, "left_semi")
    out = c.join(F.broadcast(named), c.c_nationkey == named.n_nationkey, "left_semi").filter("c_mktsegment = 'BUILDING'")
    orders = T(spark, d, "orders").filter("o_orderstatus = 'F'")
    return out.join(orders, out.c_custkey == orders.o_custkey, "left_semi").select("c_custkey", "c_nationkey")


def _span_overlap(spark, d):
    spans = T(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return spans.filter(filters.overlaps(F.col("first").cast("timestamp_ntz"), F.col("last").cast("timestamp_ntz"), "2024-01-10", "2024-01-12")).select("user_id", "n")


def _live_documents(spark, d):
    """Orders all of whose lines were kept: a line returned is a dead receipt."""
    lines = T(spark, d, "lineitem").select("l_orderkey", F.concat_ws("#", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("receipt"), "l_returnflag")
    docs = T(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return filters.live_only(docs, lines.drop("l_returnflag"), lines.filter("l_returnflag != 'R'").select("receipt"), "l_orderkey", "receipt")


def _resolved(spark, d):
    log = T(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("rev"), (F.col("value") < 50).alias("gone"))
    return filters.latest_unless_tombstone(log, ["user_id", "event_type"], "rev", "gone").select("user_id", "event_type", "rev")


def _star(spark, d):
    l, o, c, n = (T(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    joined = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return joined.filter("o_orderdate >= '1996-01-01'").groupBy("n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def _profile_defaults(spark, d):
    profiles = T(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"), "c_mktsegment", F.lit(30).alias("half_life"))
    o = T(spark, d, "orders")
    out = o.join(profiles, o.o_custkey == profiles.k, "left")
    return out.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unclassified")).alias("family"), F.coalesce("half_life", F.lit(180)).alias("half_life"))


def _alias_names(spark, d):
    """Name or alias, case-insensitive, distinct: OR as a union of two equi joins."""
    wanted = T(spark, d, "nation").select(F.lower("n_name").alias("q"), "n_nationkey")
    actors = T(spark, d, "supplier").select("s_suppkey", F.upper("s_name").alias("name"), "s_nationkey")
    named = T(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("alias"))
    people = actors.join(F.broadcast(named), actors.s_nationkey == named.k)
    by_name = people.join(wanted, F.lower("name") == wanted.q)
    by_alias = people.join(wanted, F.lower("alias") == wanted.q)
    return by_name.union(by_alias).select("s_suppkey", F.col("q").alias("matched")).distinct()


def _months_of_orders(spark, d):
    """Customer spans against months: one row for each month a span touches."""
    o = T(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    months = o.select("o_custkey", F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))).alias("bucket"))
    return months.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_open"), F.min("o_custkey").alias("least"))


def _three_key(spark, d):
    l = T(spark, d, "lineitem")
    keys = ["l_suppkey", "l_returnflag", "l_linestatus"]
    a = l.filter("l_quantity > 45").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_big"))
    b = l.filter("l_discount < 0.02").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_full"))
    return a.join(b, keys)


def _entity_overlap(spark, d):
    """Customers that share parts with the context customers, by one pass over shared values."""
    l, o = T(spark, d, "lineitem"), T(spark, d, "orders")
    bought = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("p"))
    values = bought.filter("c <= 10").select("p").distinct()
    shared = bought.filter("c > 10").join(values, "p").groupBy("c").agg(F.count_distinct("p").alias("overlap"))
    return shared.orderBy(F.desc("overlap"), "c").limit(25)


def _full_right_cross(spark, d):
    n, r = T(spark, d, "nation"), T(spark, d, "region")
    s = T(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_supp"))
    c = T(spark, d, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_cust"))
    full = s.join(c, s.s_nationkey == c.c_nationkey, "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("k"), "n_supp", "n_cust")
    pairs = n.select("n_nationkey").crossJoin(F.broadcast(r.select("r_regionkey")))  # 25 x 5 constant rows
    return full.join(pairs, full.k == pairs.n_nationkey, "right").select("n_nationkey", "r_regionkey", "n_supp", "n_cust")


def _scoreboard(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = T(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"), F.max("o_orderdate").alias("last")
    )
    age = F.datediff(F.lit("1998-08-02").cast("date"), F.col("last"))
    bucket = F.when(F.col("last").isNull(), "empty").when(age <= 30, "fresh").when(age <= 365, "recent").otherwise("stale")
    return (
        c.join(o, c.c_custkey == o.o_custkey, "left")
        .groupBy("c_mktsegment", bucket.alias("freshness"))
        .agg(F.count(F.lit(1)).alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.coalesce(F.sum("done"), F.lit(0)).alias("n_done"), F.round(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total"))
    )


def _exclusive(spark, d):
    """Parts that only suppliers of one nation deliver, all of them with a good balance."""
    l, s = T(spark, d, "lineitem"), T(spark, d, "supplier")
    return (
        l.join(s, l.l_suppkey == s.s_suppkey)
        .groupBy("l_partkey")
        .agg(F.count_distinct("s_nationkey").alias("n_nations"), F.every(F.col("s_acctbal") > 0).alias("sound"))
        .filter("n_nations = 1 and sound")
        .select("l_partkey")
    )


def _metrics(spark, d):
    e = T(spark, d, "events")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.max("event_id").alias("head"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("span_us"))


def _ordered_array(spark, d):
    l = T(spark, d, "lineitem")
    item = F.struct("l_linenumber", "l_partkey")
    return l.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"),
        F.max_by("l_partkey", F.struct("l_quantity", "l_linenumber", "l_partkey")).alias("largest"),
        F.min_by("l_partkey", item).alias("first"),
    )


def _parity(spark, d):
    o, l = T(spark, d, "orders"), T(spark, d, "lineitem")
    shared = o.join(l.select("l_orderkey").distinct(), o.o_orderkey == F.col("l_orderkey"), "left")
    return shared.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("eligible"), F.count("l_orderkey").alias("represented"), F.sum(F.col("l_orderkey").isNull().cast("int")).alias("missing"))


def _rollup(spark, d):
    e = T(spark, d, "events")
    return e.rollup("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _cube(spark, d):
    return T(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


def _sets(spark, d):
    o, c = T(spark, d, "orders"), T(spark, d, "customer")
    ordering = o.select(F.col("o_custkey").alias("k"))
    rich = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("k"))
    parts = {"union": ordering.union(rich).distinct(), "both": ordering.intersect(rich), "rest": rich.exceptAll(ordering.distinct())}
    tagged = [df.select(F.lit(k).alias("part"), "k") for k, df in parts.items()]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


def _set_equality(spark, d):
    """Order keys against line keys, both ways; equal sets leave nothing."""
    return set_difference(T(spark, d, "orders").select(F.col("o_orderkey").alias("k")), T(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")))


def set_difference(orders, lines):
    """Rows of `orders` and distinct keys of `lines` that the other side lacks, by `side`; a null key is lacked by either.

    One grouping of both sides by key, so a task holds counts of its keys and sorts no rows.
    """
    both = orders.select("k", F.lit(1).alias("o"), F.lit(0).alias("l")).union(lines.select("k", F.lit(0), F.lit(1)))
    per = both.groupBy("k").agg(F.sum("o").alias("o"), F.max("l").alias("l"))
    left = F.when(F.col("k").isNull() | (F.col("l") == 0), F.struct(F.lit("orders only").alias("side"), F.col("o").alias("n")))
    right = F.when(F.col("k").isNull() | (F.col("o") == 0), F.struct(F.lit("lines only").alias("side"), F.col("l").cast("long").alias("n")))
    sides = per.select("k", F.explode(F.array_compact(F.array(left, right))).alias("s")).select("k", "s.*").filter("n > 0")
    return sides.groupBy("side").agg(F.sum("n").alias("n"), F.sum(F.col("k") * F.col("n")).alias("total"))


def _page(spark, d):
    o = T(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(21).select("o_orderkey", "o_custkey")
    return o.withColumn("complete", F.count(F.lit(1)).over(W.partitionBy()) <= 20)


def _revenue(spark, d):
    l = T(spark, d, "lineitem").filter("l_shipdate <= '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("quantity"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n")
    )


def _percentiles(spark, d):
    e = T(spark, d, "events")
    found = selection.percentiles(e, ["event_type"], "value", {"p95": 0.95}, {"p50_nearest": 0.5})
    sums = e.groupBy("event_type").agg(F.round(F.stddev_samp("value"), 6).alias("stdev"), F.min("value").alias("least"), F.max("value").alias("most"))
    found = found.withColumnRenamed("event_type", "kind")
    return sums.join(found, F.col("event_type").eqNullSafe(F.col("kind")), "left").select("event_type", F.round("p95", 6).alias("p95"), "p50_nearest", "stdev", "least", "most")


def _map_sums(spark, d):
    per = T(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    return maps.select(F.explode("counts").alias("event_type", "n")).groupBy("event_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_maps"))


def _duplicates(spark, d):
    return T(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.unhex(F.md5(F.col("text").cast("binary")))).alias("n_texts")).filter("n > n_texts")


def _neighbours(spark, d):
    """Rows within two places of an anchor in its conversation."""
    c = T(spark, d, "conversations")
    ranked = c.select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("at"))
    anchors = ranked.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("anchor"), F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)).alias("at"))
    return anchors.join(ranked, ["conv_id", "at"]).select("conv_id", "anchor", "turn", "role")


QUERIES = {
    "flt02_read_filters": (_orders_filtered, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate <= '1996-12-31' AND o_orderstatus IN ('F','O') AND o_orderpriority ILIKE '%urgent%'"),
    "flt04_source_sets": (_customers_by_sources, "SELECT c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('EUROPE','ASIA'))) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"),
    "flt05_time_overlap": (_span_overlap, "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) >= '2024-01-10' AND min(ts) <= '2024-01-12'"),
    "flt08_live_receipts": (_live_documents, "SELECT o_orderkey AS l_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
    "flt09_tombstones": (_resolved, "SELECT user_id, event_type, event_id AS rev FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1 AND value >= 50"),
    "jon01_inner_chain": (_star, "SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= '1996-01-01' GROUP BY n_name"),
    "jon03_profile_defaults": (_profile_defaults, "SELECT o_orderkey, coalesce(c_mktsegment, 'unclassified') AS family, CASE WHEN c_custkey IS NULL THEN 180 ELSE 30 END AS half_life FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey"),
    "jon04_semi": (lambda s, d: T(s, d, "part").join(T(s, d, "lineitem").filter("l_quantity >= 50"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey"), "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)"),
    "jon05_anti": (lambda s, d: T(s, d, "customer").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "jon06_unembedded": (lambda s, d: T(s, d, "documents").join(T(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").select("doc_id"), "SELECT doc_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id WHERE vec_id IS NULL"),
    "jon11_month_overlap": (_months_of_orders, "WITH s AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) a, date_trunc('month', max(o_orderdate)) b FROM orders GROUP BY 1) SELECT CAST(bucket AS DATE) AS bucket, count(*) AS n_open, min(o_custkey) AS least FROM (SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS bucket FROM s) GROUP BY 1"),
    "jon13_alias": (_alias_names, "SELECT DISTINCT s_suppkey, lower(w.n_name) AS matched FROM supplier JOIN nation n ON s_nationkey = n.n_nationkey JOIN nation w ON lower(s_name) = lower(w.n_name) OR lower(n.n_name) = lower(w.n_name)"),
    "jon14_three_keys": (_three_key, "SELECT l_suppkey, l_returnflag, l_linestatus, n_big, n_full FROM (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) n_big FROM lineitem WHERE l_quantity > 45 GROUP BY ALL) JOIN (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) n_full FROM lineitem WHERE l_discount < 0.02 GROUP BY ALL) USING (l_suppkey, l_returnflag, l_linestatus)"),
    "jon19_neighbours": (_neighbours, "WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at FROM conversations) SELECT a.conv_id, a.turn AS anchor, b.turn, b.role FROM r a JOIN r b ON a.conv_id = b.conv_id AND abs(a.at - b.at) <= 2 WHERE a.role = 'assistant'"),
    "jon23_entity_overlap": (_entity_overlap, "WITH b AS (SELECT o_custkey c, l_partkey p FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT c, count(DISTINCT p) AS overlap FROM b WHERE c > 10 AND p IN (SELECT p FROM b WHERE c <= 10) GROUP BY c ORDER BY overlap DESC, c LIMIT 25"),
    "jon24_full_right_cross": (_full_right_cross, "WITH s AS (SELECT s_nationkey, count(*) n_supp FROM supplier GROUP BY 1), c AS (SELECT c_nationkey, count(*) n_cust FROM customer WHERE c_acctbal > 9000 GROUP BY 1), f AS (SELECT coalesce(s_nationkey, c_nationkey) k, n_supp, n_cust FROM s FULL JOIN c ON s_nationkey = c_nationkey) SELECT n_nationkey, r_regionkey, n_supp, n_cust FROM f RIGHT JOIN (nation CROSS JOIN region) ON k = n_nationkey"),
    "jon25_min_parent": (lambda s, d: (lambda o: T(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first_order"))(T(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_order"))), "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer"),
    "agg01_scoreboard": (_scoreboard, "WITH o AS (SELECT o_custkey, count(*) n, sum(o_totalprice) total, count(*) FILTER (WHERE o_orderstatus = 'F') done, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT c_mktsegment, CASE WHEN last IS NULL THEN 'empty' WHEN date_diff('day', CAST(last AS DATE), DATE '1998-08-02') <= 30 THEN 'fresh' WHEN date_diff('day', CAST(last AS DATE), DATE '1998-08-02') <= 365 THEN 'recent' ELSE 'stale' END AS freshness, count(*) n_customers, CAST(coalesce(sum(n), 0) AS BIGINT) n_orders, CAST(coalesce(sum(done), 0) AS BIGINT) n_done, round(coalesce(sum(total), 0), 2) total FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY ALL"),
    "agg04_metrics": (_metrics, "SELECT count(*) n, count(DISTINCT user_id) n_users, max(event_id) head, epoch_us(max(ts)) - epoch_us(min(ts)) span_us FROM events"),
    "agg05_parity": (_parity, "SELECT o_orderstatus, count(*) eligible, count(k) represented, count(*) - count(k) missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey k FROM lineitem) ON o_orderkey = k GROUP BY 1"),
    "agg06_exclusive": (_exclusive, "SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) = 1 AND bool_and(s_acctbal > 0)"),
    "agg07_duplicates": (_duplicates, "SELECT source, lang, count(*) n, count(DISTINCT text) n_texts FROM documents GROUP BY ALL HAVING count(*) > count(DISTINCT text)"),
    "agg08_ordered_arrays": (_ordered_array, "SELECT l_orderkey, string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts, first(l_partkey ORDER BY l_quantity DESC, l_linenumber DESC, l_partkey DESC) AS largest, first(l_partkey ORDER BY l_linenumber, l_partkey) AS first FROM lineitem GROUP BY 1"),
    "agg16_percentiles": (_percentiles, "SELECT event_type, round(quantile_cont(value, 0.95), 6) p95, quantile_disc(value, 0.5) p50_nearest, round(stddev_samp(value), 6) stdev, min(value) least, max(value) most FROM events GROUP BY 1"),
    "agg21_map_sums": (_map_sums, "SELECT event_type, count(*) n, count(DISTINCT user_id) n_maps FROM events GROUP BY 1"),
    "agg32_rollup": (_rollup, "SELECT event_type, CAST(ts AS DATE) AS day, count(*) n, round(sum(value), 2) total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))"),
    "agg32_cube": (_cube, "SELECT l_returnflag, l_linestatus, count(*) n, sum(l_quantity) quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "agg_revenue": (_revenue, "SELECT l_returnflag, l_linestatus, sum(l_quantity) quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) discount, count(*) n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL"),
    "set01_sets": (_sets, "WITH o AS (SELECT o_custkey k FROM orders), r AS (SELECT c_custkey k FROM customer WHERE c_acctbal > 5000) SELECT part, count(*) n, CAST(sum(k) AS BIGINT) total FROM (SELECT 'union' part, k FROM (SELECT k FROM o UNION SELECT k FROM r) UNION ALL SELECT 'both', k FROM (SELECT k FROM o INTERSECT SELECT k FROM r) UNION ALL SELECT 'rest', k FROM (SELECT k FROM r EXCEPT SELECT k FROM o)) GROUP BY 1"),
    "set06_set_equality": (_set_equality, "SELECT side, count(*) n, CAST(sum(k) AS BIGINT) total FROM (SELECT 'orders only' side, o_orderkey k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'lines only', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) GROUP BY 1"),
    "top17_page": (_page, "SELECT o_orderkey, o_custkey, count(*) OVER () <= 20 AS complete FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 21 OFFSET 40)"),
}
