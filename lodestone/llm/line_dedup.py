"""Line dedup by winnowing: repeated runs of lines go, but for their first place.

A document is the sequence of the hashes of its lines that hold a word. Its windows
are all runs of `WINDOW` lines, and shorter runs that hold `LEAST_WORDS` words. The
least hash in a window (the last of equals) is a fingerprint, so two equal windows
hold a common fingerprint at the same place. Only fingerprints that occur twice go
on. Each position of these is extended both ways to the windows around it; a window
that stands earlier elsewhere, by (doc_id, place), is a repeat. The union of the
repeats is every repeated run, as far as its lines agree both ways, and is deleted.
First places are grouped minima: occurrences are never paired, and a fingerprint or
window that many lines share is met by broadcast.

Defined results: order is by doc_id, null ids last, then a hash of the text; rows
that repeat an id and a text are one document and get one result; a null text is
empty; lines without a word are no part of a run and stay; a run of fewer lines and
fewer words than a window stays; an empty table gives an empty result; clashing
columns are replaced. Lines are compared as they are, by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 3
LEAST_WORDS = 20


def _lines(text: Column) -> Column:
    return F.split(C.text_or_empty(text), "\n", -1)


def _places(lines: Column) -> Column:
    """Indices of the lines that hold a word."""
    return F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: F.get(lines, i).rlike(C.HAS_WORD),
    )


def _measured(text: Column) -> Column:
    """struct(h, n) of each line with a word: its hash and its words."""
    return F.transform(
        F.filter(_lines(text), lambda li: li.rlike(C.HAS_WORD)),
        lambda li: F.struct(F.xxhash64(li).alias("h"), F.regexp_count(li, F.lit(C.HAS_WORD + "+")).alias("n")),
    )


def _fingerprints(lines: Column, window: int, least_words: int) -> Column:
    """struct(f, windows: of (start, size, hash)) for each selected position of `lines`."""
    none = F.array().cast("array<struct<start:int,size:int,hash:bigint>>")

    def held(x: Column, s: Column, k: int) -> Column:
        """Whether the run of k lines from s on is a window."""
        enough = sum((F.get(x, s + j)["n"] for j in range(1, k)), F.get(x, s)["n"]) >= least_words
        return (s >= 0) & (s + k <= F.size(x)) & (enough if k < window else F.lit(True))

    def least(x: Column, s: Column, k: int) -> Column:
        return -F.array_min(F.array(*[F.struct(F.get(x, s + j)["h"].alias("h"), (-(s + j)).alias("p")) for j in range(k)]))["p"]

    def selected(x: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda s: F.array(*[F.when(held(x, s, k), least(x, s, k)) for k in range(1, window + 1)]))
        return F.array_distinct(F.array_compact(F.flatten(at)))

    def around(x: Column, p: Column) -> Column:
        each = [
            F.when(held(x, p - j, k), F.struct((p - j).alias("start"), F.lit(k).alias("size"), F.xxhash64(*[F.get(x, p - j + i)["h"] for i in range(k)]).alias("hash")))
            for k in range(1, window + 1)
            for j in range(k)
        ]
        return F.array_compact(F.array(*each))

    return F.when(F.size(lines) > 0, F.transform(selected(lines), lambda p: F.struct(F.get(lines, p)["h"].alias("f"), around(lines, p).alias("windows")))).otherwise(
        F.array().cast("array<struct<f:bigint,windows:array<struct<start:int,size:int,hash:bigint>>>>")
    )


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """__id, __text, runs: start and size of the windows of lines that stand earlier elsewhere."""
    body = F.col(f"`{text}`")
    marked = docs.select(*C.row_key(F.col(f"`{doc_id}`"), body), C.let(_measured(body), lambda x: _fingerprints(x, window, least_words)).alias("marks"))
    marks = C.durable(marked.select("__id", "__text", F.explode("marks").alias("m")).select("__id", "__text", "m.f", "m.windows"))
    often = C.durable(marks.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    placed = C.join_counted(marks, often, "f").select(F.explode("windows").alias("w"), F.struct("__id", "__text", "w.start").alias("at"))
    placed = C.durable(placed.select(F.col("w.hash").alias("hash"), "at", F.col("w.size").alias("size")))
    first = placed.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    first = C.durable(first.filter("first < last").drop("last"))
    later = C.join_counted(placed, first, "hash").filter("at > first")
    return later.groupBy("at.__id", "at.__text").agg(F.sort_array(F.collect_set(F.struct("at.start", "size"))).alias("runs"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` with `text` cut, n_lines, n_removed and `removed`, the indices of the lines that went."""
    names = docs.columns
    found = C.durable(repeats(docs, doc_id, text, window, least_words))
    body = F.col(f"`{text}`")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), body.cast("string").alias("body"), *C.row_key(F.col(f"`{doc_id}`"), body))
    met = C.left_join_few(keyed, found, ["__id", "__text"])
    gone = C.let(
        _places(_lines(F.col("body"))),
        lambda places: F.transform(
            F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))),
            lambda k: F.get(places, k),
        ),
    )
    cut = C.let(
        _lines(F.col("body")),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: F.get(lines, i)), "\n"
        ),
    )
    n_lines = F.size(F.filter(_lines(F.col("body")), lambda li: li.rlike(C.HAS_WORD))).cast("long")
    out = met.withColumn("removed", F.when(F.col("runs").isNotNull(), gone).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("cut", F.when(F.size("removed") > 0, cut).otherwise(F.col("body")))
    added = {"n_lines": n_lines, "n_removed": F.size("removed").cast("long"), "removed": F.col("removed")}
    same = [(F.col("cut") if c == text else F.col("row")[c]).alias(c) for c in names if c.lower() not in added]
    return out.select(*same, *[v.alias(k) for k, v in added.items()])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_emptied: bool = True) -> DataFrame:
    """`docs` with its columns as they came and repeated runs of lines cut from the text.

    A row that loses every line with a word stands whole in others; it goes if `keep_emptied` is false.
    """
    names = docs.columns
    out = line_dedup(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    if not keep_emptied:
        out = out.filter("n_removed = 0 or n_removed < n_lines")
    return out.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in names])


def query(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    joined = F.array_join(F.transform(F.sort_array("removed"), lambda i: i.cast("string")), ",")
    return out.select("doc_id", "n_lines", "n_removed", joined.alias("removed"), F.md5(C.text_or_empty(F.col("text")).cast("binary")).alias("text_md5"))


def oracle(window: int = WINDOW, least_words: int = LEAST_WORDS) -> str:
    """DuckDB SQL for `query`: all windows of lines, first places by rank."""
    content = lambda k: " || chr(10) || ".join(f"lead(line, {j}) OVER w" for j in range(k))
    held = lambda k: " + ".join(f"lead(words, {j}) OVER w" for j in range(k))
    legs = " UNION ALL ".join(f"SELECT doc_id, k, {k} AS size, {content(k)} AS c, {held(k)} AS words FROM said WINDOW w AS (PARTITION BY doc_id ORDER BY k)" for k in range(1, window + 1))
    return f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
said AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines
         WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
win AS ({legs}),
late AS (SELECT doc_id, k, size FROM win WHERE c IS NOT NULL AND (size = {window} OR words >= {least_words})
         QUALIFY row_number() OVER (PARTITION BY size, c ORDER BY doc_id NULLS LAST, k) > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM late l JOIN said s ON s.doc_id = l.doc_id AND s.k BETWEEN l.k AND l.k + l.size - 1),
per AS (
  SELECT l.doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i), '') AS removed,
         coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i), '') AS kept
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, removed, md5(kept) AS text_md5 FROM per
"""
