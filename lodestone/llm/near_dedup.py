"""MinHash near-duplicates with bottom-k sketches from one hash function.

1. Every text becomes the set of its word shingles; texts with equal words form a
   class, and one representative stands for it. The sketch of a set is its k
   least hash values; a set of up to k shingles is its own sketch.
2. Two sets with the wanted similarity share at least a share `SHARED` of their
   sketches (but for a chance of about 2e-9 a pair, see there). So it is enough to
   look up the rarest part of each sketch, rare by the number of classes that
   retain a value: two sketches with that overlap meet in it. Inverted lists of
   these values give candidate pairs; the union sketch of a pair estimates its
   similarity; exact Jaccard on the full sets decides.
3. Lists longer than `LONG_LIST` would make a square of pairs. Their classes are
   put together in clusters, and each is compared with a few central classes of
   its cluster. What that leaves outside the cluster's main component, and could
   be similar to anything by the share of its shingles that others hold, is
   compared with the whole cluster in blocks, which give links and never pairs.
   So components are those of all similar pairs, at no more than
   (classes + left classes * blocks) rows.
4. Components of the links give each document its group.

Defined results: a null text, or one without words, has an empty set, is linked
with nothing and is its own component; a text of fewer words than a shingle has one
shingle, the whole sequence; repeated rows are one class; rows with a null id take
the least id of their component, or null if it has none; an empty table gives an
empty result. Hashes are 64 bits wide, class digests 128.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .graph import components

SKETCH = 48
#: Overlap of two sketches that is asked for. A similarity of 0.85 gives 48 values of
#: which each is shared with probability 0.85: fewer than 24 are with 2.2e-9, and
#: with 0.8 fewer than 20 with 1e-8.
SHARED = {85: 0.5, 80: 0.4167}
LONG_LIST = 32
HUBS = 8
BLOCK = 256
#: Rows that the semi-join filter on hash buckets can have, whatever the data.
BUCKETS = 1 << 20


def shingle_hashes(words: Column, n: int) -> Column:
    """Distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""

    def build(h: Column) -> Column:
        return (
            F.when(F.size(h) >= n, F.array_distinct(C.word_windows(h, n, lambda g, i: g, "bigint")))
            .when(F.size(h) > 0, F.array(F.xxhash64(h)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return C.let(C.hash_each(words), build)


def _with_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest of the words, and the lowered text with single spaces."""
    joined = F.array_join(C.words(C.ascii_lower(F.col(f"`{text}`"))), " ")
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), joined.alias("joined")).withColumn(
        "digest", F.unhex(F.md5(F.col("joined").cast("binary")))
    )


def _set_of(joined: Column, n: int) -> Column:
    return shingle_hashes(F.array_remove(F.split(joined, " ", -1), ""), n)


def sketches(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, n_shingles and sketch (sorted) of each row."""
    return _with_words(docs, doc_id, text).select(
        "doc_id",
        "digest",
        C.let(_set_of(F.col("joined"), n), lambda s: F.struct(F.size(s).cast("long").alias("n_shingles"), F.slice(F.sort_array(s), 1, SKETCH).alias("sketch"))).alias("s"),
    ).select("doc_id", "digest", "s.n_shingles", "s.sketch")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("digest", "doc_id"), F.lit(BUCKETS)).cast("int")


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """node, n_shingles, grams of the classes in `wanted` (node, digest, doc_id).

    A filter on hash buckets, of at most BUCKETS rows, keeps other texts out of the shuffle.
    """
    near = wanted.select(_bucket().alias("bucket")).distinct()
    rows = _with_words(docs, doc_id, text).withColumn("bucket", _bucket()).join(F.broadcast(near), "bucket", "left_semi")
    grams = rows.select("digest", "doc_id", _set_of(F.col("joined"), n).alias("grams"))
    own = wanted.select("node", F.col("digest").alias("d"), F.col("doc_id").alias("i"))
    met = grams.join(own, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")))
    return met.groupBy("node").agg(F.first("grams").alias("grams")).withColumn("n_shingles", F.size("grams").cast("long"))


def _similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of `pairs` with the wanted Jaccard similarity on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    met = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return met.filter(_similar(shared, F.size("ga"), F.size("gb"), percent)).select("a", "b")


def _block_links(percent: int):
    """Links between the two sides of a block pair: for each left node, one a component."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["left"]], pdf[~pdf["left"]]
        out_a, out_b = [], []
        if len(left) and len(right):
            values = np.concatenate(right["grams"].to_numpy())
            owner = np.repeat(np.arange(len(right)), right["n_shingles"].to_numpy())
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            sizes, nodes, groups = (right[c].to_numpy() for c in ("n_shingles", "node", "component"))
            for node, grams, group in zip(left["node"], left["grams"], left["component"], strict=True):
                grams = np.asarray(grams)
                lo, hi = np.searchsorted(values, grams, "left"), np.searchsorted(values, grams, "right")
                hits = np.concatenate([owner[i:j] for i, j in zip(lo, hi, strict=True) if i < j] or [owner[:0]])
                shared = np.bincount(hits, minlength=len(nodes))
                linked = (100 * shared >= percent * (sizes + len(grams) - shared)) & (groups != group)
                _, first = np.unique(groups[linked], return_index=True)
                for b in nodes[linked][first]:
                    out_a.append(node)
                    out_b.append(b)
        return pd.DataFrame({"a": np.array(out_a, dtype="int64"), "b": np.array(out_b, dtype="int64")})

    return compare


def _hot_links(hot: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links that join up the clusters of long lists; `known` are links found already."""
    offset = F.lit(1 << 62)  # values stand beside nodes as nodes of their own
    by_value = hot.select("node", (F.shiftrightunsigned(F.xxhash64("value"), 2) + offset).alias("value"))
    cluster = components(by_value.select(F.col("value").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "cluster")
    members = hot.select("node").distinct().join(cluster, "node")
    members = C.durable(members.join(sets, "node"))
    gram = members.select("node", F.explode("grams").alias("gram"))
    common = gram.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
    held = gram.join(common, "gram", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    members = members.join(held, "node", "left").fillna(0, ["held"])
    slim = C.durable(members.select("node", "cluster", "n_shingles", "held"))
    able = slim.filter(F.col("held") * 100 >= percent * F.col("n_shingles"))
    central = F.col("held") / F.col("n_shingles")
    best = able.groupBy("cluster").agg(F.max_by("node", F.struct(central, F.col("node"))).alias("h0"), *[
        # the most central class in each of a few random parts of the cluster
        F.max_by("node", F.when(F.pmod(F.xxhash64("node"), F.lit(HUBS - 1)) == k, F.struct(central, F.col("node")))).alias(f"h{k + 1}")
        for k in range(HUBS - 1)
    ])
    hubs = best.select("cluster", F.explode(F.array_compact(F.array(*[f"h{k}" for k in range(HUBS)]))).alias("b")).distinct()
    to_hubs = able.select("cluster", F.col("node").alias("a")).join(hubs, "cluster").filter("a != b").select("a", "b")
    found = C.durable(_verify(to_hubs, members.select("node", "grams"), percent).union(known))
    group = components(found)
    placed = C.durable(able.join(group, "node", "left").withColumn("component", F.coalesce("component", "node")))
    per = placed.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"))
    out = placed.join(main, "cluster").withColumn("left", F.col("component") != F.col("main"))
    left = out.groupBy("cluster").agg(F.sum(F.col("left").cast("long")).alias("n_left"))
    out = out.join(left.filter("n_left > 0"), "cluster").join(members.select("node", "grams"), "node")
    of = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col(n) / BLOCK))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / BLOCK) - 1)
    keep = ("cluster", "node", "n_shingles", "grams", "component")
    asking = out.filter("left").select(*keep, of("n_left", 1).alias("x"), F.explode(every("size")).alias("y"), F.lit(True).alias("left"))
    asked = out.select(*keep, F.explode(every("n_left")).alias("x"), of("size", 2).alias("y"), F.lit(False).alias("left"))
    rest = asking.unionByName(asked).groupBy("cluster", "x", "y").applyInPandas(_block_links(percent), "a long, b long")
    return found.union(rest)


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b) between classes whose components are those of all similar pairs."""
    share = SHARED[percent]
    kept = classes.filter("n_shingles > 0").select("node", "n_shingles", F.explode("sketch").alias("value"))
    counts = kept.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = kept.join(counts, "value")
    mine = C.durable(shared)
    # values that no other class retains come first in the order of rarity and use up the prefix
    own = mine.groupBy("node").agg(F.count(F.lit(1)).alias("n_met"))
    size = F.least(F.col("n_shingles"), F.lit(SKETCH))
    prefix = size - F.ceil(size * share) + 1
    rank = F.row_number().over(W.partitionBy("node").orderBy("n", "value"))
    lists = (
        mine.join(own, "node")
        .withColumn("rank", rank + size - F.col("n_met"))
        .filter(F.col("rank") <= prefix)
        .select("value", "node", "n_shingles")
    )
    lists = C.durable(lists)
    lengths = lists.groupBy("value").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    measured = C.durable(lists.join(lengths, "value"))
    short = measured.filter(F.col("length") <= LONG_LIST).select("value", "node", "n_shingles")
    other = short.select("value", F.col("node").alias("b"), F.col("n_shingles").alias("nb"))
    fits = (F.col("nb") * 100 >= percent * F.col("n_shingles")) & (F.col("n_shingles") * 100 >= percent * F.col("nb"))
    pairs = short.withColumnRenamed("node", "a").join(other, "value").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    sketch = classes.select("node", "sketch")
    met = pairs.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    likely = C.let(union, lambda u: F.size(F.array_intersect(u, F.array_intersect("sa", "sb"))) >= share * F.size(u))
    pairs = C.durable(met.filter(likely).select("a", "b"))
    hot = C.durable(measured.filter(F.col("length") > LONG_LIST).select("node", "value"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    wanted = C.durable(wanted.join(classes.select("node", "digest", "doc_id"), "node"))
    sets = C.durable(_full_sets(docs, wanted, n, doc_id, text))
    direct = C.durable(_verify(pairs, sets, percent))
    if hot.isEmpty():
        return direct
    return C.durable(_hot_links(hot, sets, direct, percent))


def groups(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, n_shingles, class_size, component_id of each row of `docs`."""
    rows = C.durable(sketches(docs, n, doc_id, text))
    classes = rows.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"),
        F.count(F.lit(1)).alias("class_size"),
    )
    classes = C.durable(classes.withColumn("node", F.monotonically_increasing_id()))
    found = components(links(docs, classes, n, percent, doc_id, text))
    placed = classes.select("digest", "node", "doc_id", "n_shingles", "class_size").join(found, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "component").select("digest", "class_size", "component_id")
    out = rows.select("doc_id", "digest", "n_shingles").join(placed, "digest")
    # texts without words are linked with nothing, not with each other
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def query(docs: DataFrame) -> DataFrame:
    out = groups(docs.select("doc_id", "text"), n=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_size")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose id is the least of their group; rows with a null id stay.

    Only ids that go are held against the texts, so the join moves each text once.
    """
    found = groups(docs, n, percent, doc_id, text).filter("doc_id != component_id")
    gone = C.durable(found.select(F.col("doc_id").alias("__gone")).distinct())
    keyed = C.packed(docs, F.col(f"`{doc_id}`").cast("long").alias("__gone"))
    return C.unpacked(C.anti_join_few(keyed, gone, ["__gone"]), docs.columns)


def oracle(n: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for `query`: all pairs that share a shingle, and their closure."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: {gram}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT node, b FROM r JOIN e ON reach = a),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1),
z AS (SELECT doc_id, count(*) OVER (PARTITION BY array_to_string(w, ' ')) AS class_size FROM w)
SELECT z.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, z.doc_id = component_id AS kept, class_size
FROM z LEFT JOIN c ON c.doc_id = z.doc_id JOIN m ON m.node = z.doc_id
"""
