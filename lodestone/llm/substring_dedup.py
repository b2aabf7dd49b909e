"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: shift left, add a fixed random word for
the byte. As the word has 16 bits, it depends on the last 16 bytes alone, and is
computed for all places at once. A chunk ends after white space where the hash has
its leading `BITS` bits zero, or after any character where it is zero as a whole
(so text without spaces is cut too). Cuts move with their content: an insertion
changes the chunks around it and no others.

Sequences of neighbouring chunks are compared, by a 64-bit hash of their digests. From
each chunk on, and back from each chunk, the shortest sequence that reaches
`LEAST_WORDS` words is a window. Of the places of a window the first, by
(doc_id, place), stays; later ones are repeats, and their union is cut from the text.
Any run of chunks with that many words that stands earlier is the union of its
windows, and nothing goes that does not stand earlier in such a sequence, so phrases
that many texts share stay, in any order. Windows that occur once, nearly all, leave
after one count.

Defined results: order is by doc_id, null ids last, then a hash of the text; rows
that repeat an id and a text are one document; null and empty texts have no chunks;
an empty table gives an empty result. Long texts are hashed in pieces of bounded
size. Spans count code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

BITS = 2
CONTEXT = 16
LEAST_WORDS = 16
#: Parts that the rows of a hot window are dealt to.
SALTS = 256
PIECE = 1 << 20
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256, dtype=np.uint16)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd factor of the hash of a sequence, and its inverse in 64 bits.
FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(FACTOR, -1, 1 << 64)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, by doubling: a window of 2w is two windows of w."""
    h = GEAR[data]
    width = 1
    while width < CONTEXT:
        moved = h[:-width] << np.uint16(width)
        h = h.copy()
        h[width:] += moved
        width *= 2
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks of the bytes of one text end (exclusive), the end of the text included.

    Pieces overlap by the context of the hash, so they give the cuts of the whole.
    """
    found = []
    for begin in range(0, len(data), PIECE):
        lead = min(begin, CONTEXT)
        part = data[begin - lead : begin + PIECE]
        h = gear(part)
        cut = (((h >> np.uint16(16 - BITS)) == 0) & _SPACE[part]) | (h == 0)
        at = np.flatnonzero(cut[lead:]) + begin + 1
        found.append(at)
    ends = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    ends = ends[ends < len(data)]
    ends = ends[(data[ends] & 0xC0) != 0x80]  # never inside a character
    return np.append(ends, len(data)) if len(data) else ends


def chunks_of(text: str) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Ends in code points, digests, and words begun in each chunk of `text`."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = chunk_ends(data)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    digests = [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    if not len(ends):
        return ends, digests, ends
    space = _SPACE[data]
    begun = ~space
    begun[1:] &= space[:-1]
    words = np.add.reduceat(begun, starts, dtype=np.int64)
    chars = ends if text.isascii() else np.cumsum((data & 0xC0) != 0x80)[ends - 1]
    return chars, digests, words


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows_of(digests: list[int], words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunks, last chunks (exclusive) and hashes of the shortest sequences of `least` words that begin or end at each chunk."""
    n = len(digests)
    begun = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    each = np.arange(n + 1)
    until = np.searchsorted(begun, begun + least, side="left")
    since = np.searchsorted(begun, begun - least, side="right") - 1
    ahead, back = until <= n, since >= 0
    pairs = np.unique(np.concatenate((each[ahead] << 32 | until[ahead], since[back] << 32 | each[back])))
    a, e = pairs >> 32, pairs & 0xFFFFFFFF
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(np.array(digests, dtype=np.int64).view(np.uint64) * _powers(FACTOR, n), dtype=np.uint64)))
    hashes = (sums[e] - sums[a]) * _powers(_INVERSE, n + 1)[a] + (e - a).astype(np.uint64)
    return a, e, hashes.view(np.int64)


def _chunk(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            starts, sizes, hashes = [], [], []
            for text in frame["text"]:
                chars, digests, words = chunks_of(text or "")
                a, e, found = windows_of(digests, words, least)
                places = np.append(0, chars).astype(np.int32)
                starts.append(places[a])
                sizes.append(places[e] - places[a])
                hashes.append(found)
            yield pd.DataFrame({"id": frame["id"], "text_key": frame["text_key"], "starts": starts, "sizes": sizes, "hashes": hashes})

    return run


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart and put them in order; no null among them."""
    return [F.coalesce(doc_id.cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(C.text_or_empty(text)).alias("text_key")]


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """id, text_key, starts, sizes, hashes: the windows of each row, where they stand in code points and what they hold."""
    body = F.col(f"`{text}`")
    rows = docs.select(*_row_key(F.col(f"`{doc_id}`"), body), body.cast("string").alias("text"))
    return rows.mapInPandas(_chunk(least_words), "id long, text_key long, starts array<int>, sizes array<int>, hashes array<long>")


def later_places(found: DataFrame) -> DataFrame:
    """id, text_key, start, size, first_id of every window of `found` (a written table) that stands earlier elsewhere.

    Windows that occur once leave after a count. The few hot ones find their first
    place by a partial minimum, which is broadcast, and are dealt with a salt; the
    others find it among the rows of their key.
    """
    counted = found.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot, cold = C.split_hot(C.durable(counted))
    placed = found.select("id", "text_key", F.explode(F.arrays_zip("hashes", "starts", "sizes")).alias("w"))
    placed = placed.select("id", "text_key", F.col("w.hashes").alias("hash"), F.col("w.starts").alias("start"), F.col("w.sizes").alias("size"))
    at = F.struct("id", "text_key", "start", "size")
    marked = placed.join(F.broadcast(hot.select("hash", F.lit(True).alias("hot"))), "hash", "left")
    marked = marked.withColumn("key", F.when(F.col("hot"), F.col("hash"))).filter("key is not null")
    first = C.durable(marked.groupBy(F.col("key").alias("hash")).agg(F.min(at).alias("first")))
    dealt = placed.join(F.broadcast(first), "hash", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "text_key"), F.lit(SALTS)).cast("int")))
    keys = cold.select("hash", F.lit(0).alias("salt")).union(hot.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    again = dealt.join(keys.hint("merge"), ["hash", "salt"])
    again = again.withColumn("first", F.coalesce("first", F.min(at).over(W.partitionBy("hash", "salt"))))
    return again.filter(at > F.col("first")).select("id", "text_key", "start", "size", F.col("first.id").alias("first_id"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """id, text_key, start, end, first_id: the runs that stand earlier elsewhere.

    `first_id` is where the run's first window stands first.
    """
    later = later_places(C.durable(windows(docs, doc_id, text, least_words)))
    end = F.col("start") + F.col("size")
    in_row = W.partitionBy("id", "text_key").orderBy("start", "size")
    reached = F.max(end).over(in_row.rowsBetween(W.unboundedPreceding, -1))
    begins = F.when(F.col("start") <= reached, 0).otherwise(1)
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_row.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("id", "text_key", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.min(F.struct("start", "size", "first_id")).alias("f"))
    return runs.select("id", "text_key", "start", "end", F.col("f.first_id").alias("first_id"))


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with repeated runs cut from the text, and `removed`, their spans in the text as it was."""
    names = docs.columns
    body = F.col(f"`{text}`")
    runs = C.durable(repeats(docs, doc_id, text, least_words))
    per = runs.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), body.cast("string").alias("body"), *_row_key(F.col(f"`{doc_id}`"), body))
    met = C.left_join_few(keyed, per, ["id", "text_key"]).withColumn("removed", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")))
    kept = F.transform(
        F.sequence(F.lit(0), F.size("removed")),
        lambda i: F.struct(
            F.when(i > 0, F.get("removed", i - 1)["end"]).otherwise(F.lit(0)).alias("a"),
            F.coalesce(F.get("removed", i)["start"], F.length("body")).alias("b"),
        ),
    )
    joined = F.array_join(F.transform(kept, lambda s: F.substring(F.col("body"), s["a"] + 1, s["b"] - s["a"])), "")
    cut = F.when(F.size("removed") > 0, joined).otherwise(F.col("body"))
    same = [(cut.alias(c) if c == text else F.col("row")[c].alias(c)) for c in names if c.lower() != "removed"]
    return met.select(*same, "removed")


def query(docs: DataFrame) -> DataFrame:
    """A row for each run that goes: where it is, and the document that has it first."""
    null = F.lit((1 << 63) - 1)
    runs = repeats(docs.select("doc_id", "text"))
    return runs.select(F.nullif("id", null).alias("doc_id"), F.nullif("first_id", null).alias("first_doc_id"), "start", "end")
