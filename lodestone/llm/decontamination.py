"""Benchmark decontamination: rare n-gram seeds find passages, alignment scores them.

Seeds are the n-grams of words of the test items but for common ones: those whose
chance at a place, from how often each of their words occurs in the whole corpus, is
below `COMMON`, and the rarer half of an item's at any rate, so the share of seeds
does not shrink as the corpus grows. Rarity is never taken from how many documents
hold a seed, so an item that leaked into many of them keeps its seeds. Three words
survive an edit of every fourth one. Seeds meet the n-grams of all documents in a
hash join. A meeting puts the item's start on a diagonal; meetings of one document
and item on near diagonals are one region, which counts if it holds a seed that the
corpus would hardly hold by chance (expected less than `RARE` times, or among the
`LEAST_SEEDS` rarest of its item), or two seeds. Smith-Waterman over the words of region and item
(match 2, mismatch -1, gap -1) scores the copy, edits included; the score over that
of a verbatim copy, at least `SCORE`, makes a match.

Defined results: null texts and items are empty and match nothing; an item shorter
than a seed is one seed as a whole; rows that repeat an id and a text give one
match; null ids come back as null; items that repeat an id are matched one by one;
an empty table on either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED_WORDS = 3
COMMON = 1e-7
RARE = 1.0
LEAST_SEEDS = 3
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Rows up to which the seeds or the items' words are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
BUCKETS = 1 << 20


def _hashes(text: Column) -> Column:
    return C.hash_each(C.words(F.lower(C.text_or_empty(text))))


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of the n-grams; of the whole sequence if it is shorter."""
    return F.when(F.size(hashes) >= n, C.word_windows(hashes, n, lambda g, i: g, "bigint")).otherwise(
        F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    )


def _small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it is within the bound."""
    return F.broadcast(df) if C.bounded(df, BROADCAST_ROWS) else df


def seeds(docs: DataFrame, items: DataFrame, text: str = "text", n: int = SEED_WORDS) -> DataFrame:
    """item (row number), item_id, words (hashes), gram, at, rare: the n-grams of the items that are not common.

    `items` has item_id and text.
    """
    listed = items.select("item_id", _hashes(F.col("text")).alias("words")).filter(F.size("words") > 0)
    listed = C.durable(listed.withColumn("item", F.monotonically_increasing_id()))
    vocabulary = C.durable(listed.select(F.explode("words").alias("word")).distinct())
    said = docs.select(F.explode(_hashes(F.col(f"`{text}`"))).alias("word"))
    known = vocabulary.withColumn("known", F.col("word"))
    if C.bounded(vocabulary, BROADCAST_ROWS):
        met = said.join(F.broadcast(known), "word", "left").groupBy("known").agg(F.count(F.lit(1)).alias("n"))
    else:  # words are counted before they meet the items' ones, so none fills a task
        met = said.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(known, "word", "left").groupBy("known").agg(F.sum("n").alias("n"))
    counts = C.durable(met)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1.0
    placed = listed.select("item", F.posexplode("words").alias("at", "known")).join(counts, "known", "left")
    logs = placed.select("item", "at", F.log((F.coalesce("n", F.lit(0)) + 0.5) / total).alias("p"))
    per = logs.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]).alias("p"))
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("p") - n, F.lit(0))),
        lambda i: F.struct(
            F.aggregate(F.slice("p", i + 1, n), F.lit(float(np.log(total))), lambda a, b: a + b).alias("expected"),
            i.alias("at"),
        ),
    )
    rare = lambda x, k: (x["expected"] < float(np.log(RARE))) | (k < LEAST_SEEDS)
    marked = lambda x, k: F.struct(x["at"].alias("at"), rare(x, k).alias("rare"), ((x["expected"] < float(np.log(COMMON * total))) | (2 * k < F.size("s"))).alias("taken"))
    chosen = per.select("item", F.sort_array(spans).alias("s")).select("item", F.explode(F.transform("s", marked)).alias("x")).filter("x.taken or x.rare")
    found = chosen.join(listed, "item").select("item", "item_id", "words", F.get(_grams(F.col("words"), n), F.col("x.at")).alias("gram"), F.col("x.at").alias("at"), F.col("x.rare").alias("rare"))
    return C.durable(found)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(C.text_or_empty(text)).alias("text_key")]


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BUCKETS)).cast("int")


def regions(docs: DataFrame, seeded: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SEED_WORDS) -> DataFrame:
    """doc_id, text_key, item, slot, n_seeds: where seeds of an item fall together.

    Slots are steps of the item's length along the diagonals.
    """
    body = F.col(f"`{text}`")
    grams = docs.select(*_row_key(F.col(f"`{doc_id}`"), body), C.let(_hashes(body), lambda h: _grams(h, n)).alias("grams"))
    said = grams.select("doc_id", "text_key", F.posexplode("grams").alias("pos", "gram"))
    slim = seeded.select("gram", "item", "at", "rare", F.size("words").alias("length"))
    if C.bounded(slim, BROADCAST_ROWS):
        met = said.join(F.broadcast(slim), "gram")
    else:  # only n-grams in a bucket of a seed are shuffled
        near = F.broadcast(slim.select(C.bucket("gram").alias("__bucket")).distinct())
        met = said.withColumn("__bucket", C.bucket("gram")).join(near, "__bucket", "left_semi").drop("__bucket").join(slim, "gram")
    slot = F.floor((F.col("pos") - F.col("at")) / F.col("length")).cast("int")
    found = met.groupBy("doc_id", "text_key", "item", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n_seeds"), F.max("rare").alias("rare"))
    return found.filter("rare or n_seeds > 1").drop("rare")


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of `a` along `b`, and where in `b` it ends (exclusive)."""
    places = np.arange(len(b) + 1)
    row, best, end = np.zeros(len(b) + 1, dtype=np.int64), 0, 0
    for x in a:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new - GAP * places) + GAP * places
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def _align(item: pd.Series, region: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(item, region, strict=True):
        a, b = np.asarray(a), np.asarray(b)
        best, end = smith_waterman(a, b)
        length = smith_waterman(a[::-1], b[:end][::-1])[1]
        out.append((best / (MATCH * len(a)), end - length, end))
    return pd.DataFrame(out, columns=["score", "start", "end"])


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SCORE) -> DataFrame:
    """doc_id, text_key, item_id, score, start, end (words): the best match of each document and item."""
    seeded = seeds(docs, items, text)
    found = C.durable(regions(docs, seeded, doc_id, text))
    body = F.col(f"`{text}`")
    near = found.select(_bucket().alias("bucket")).distinct()
    rows = docs.select(*_row_key(F.col(f"`{doc_id}`"), body), body.alias("body")).withColumn("bucket", _bucket())
    rows = rows.join(F.broadcast(near), "bucket", "left_semi").dropDuplicates(["doc_id", "text_key"])
    held = rows.select(F.col("doc_id").alias("i"), F.col("text_key").alias("t"), _hashes(F.col("body")).alias("said"))
    listed = seeded.select("item", "item_id", "words").dropDuplicates(["item"])
    met = found.join(held, (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("i"))).join(_small(listed), "item")
    length = F.size("words")
    pad = (length / 4).cast("int") + 2
    begin = F.greatest(F.col("slot") * length - pad, F.lit(0))
    until = (F.col("slot") + 2) * length + pad
    cut = met.select("doc_id", "text_key", "item_id", "words", begin.alias("begin"), F.slice("said", begin + 1, F.greatest(until - begin, F.lit(1))).alias("region"))
    scored = cut.withColumn("m", F.pandas_udf(_align, "score double, start int, end int")("words", "region")).filter(F.col("m.score") >= least)
    best = scored.groupBy("doc_id", "text_key", "item_id").agg(F.max_by(F.struct("m.score", (F.col("begin") + F.col("m.start")).alias("start"), (F.col("begin") + F.col("m.end")).alias("end")), F.struct("m.score", -F.col("begin"))).alias("b"))
    return best.select("doc_id", "text_key", "item_id", "b.score", "b.start", "b.end")


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that match no item."""
    body, own = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    id_key = C.row_key(F.col("doc_id"), F.lit(""))[0]
    found = C.durable(matches(docs, items, doc_id, text).select(id_key, F.col("text_key").alias("__text")).distinct())
    return C.unpacked(C.anti_join_few(C.packed(docs, *C.row_key(own, body)), found, ["__id", "__text"]), docs.columns)


def query(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = matches(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start", "end")
