"""Source divergence audit: how far each source's words stray from other sources' and its language's.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lowered. Two passes:

1. Exact document frequencies by language and term, as grouped sums; terms in at least
   `LEAST_DOCS` documents of a language are its vocabulary.
2. Blocks of texts are scanned with an Aho-Corasick automaton of the kept terms that
   occur in the block, each padded with a delimiter on both sides, over texts whose
   other characters are delimiters; its hits are the counts by language, source and term.

No task holds a whole vocabulary and none is broadcast: tasks get a bitmap of fixed
size that tells which terms may be kept. A block's automaton is made of the block's
own terms that the bitmap lets through, so it is bounded by the block; counts of terms
that came through by chance of the bitmap are taken off by the join with the exact
vocabulary. A vocabulary too large for the bitmap costs rows in that join, no result.

What comes of it are sparse postings: a row for each group (language and source) and
term with a count above zero. A pair of groups is compared over the whole vocabulary:
terms that neither has give one constant each, terms of one side give their share by
the histogram of that side's counts, and terms of both are met by a join of postings.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), the divergence of p from q
is floor((p - q)^2 / q), in whole numbers throughout.

Defined results: null texts, languages and sources count as ''; a group without terms
is compared too; a language without kept terms gives its pairs the value 0; rows that
repeat are documents of their own; an empty table gives an empty result; only the
three columns named are read, whatever others there are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Bytes of terms with A-Z lowered; other ASCII characters are delimiters.
TERMS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)).lower()
LEAST_DOCS = 3
BEST_TERMS = 200
SCALE = 1_000_000_000
#: Bits of the bitmap of kept terms, 8 MB whatever the vocabulary.
BITS = 1 << 26
#: Bytes of text of a block, or one longer text.
BLOCK = 1 << 23
#: Bits that one row of Spark's bitmap aggregate holds.
BITMAP_BITS = 32_768


def prepared(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source and the UTF-8 bytes of the text, none null."""
    empty = lambda c: C.text_or_empty(F.col(f"`{c}`"))
    return docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("body"))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[dict[str, dict[str, list[bytes]]]]:
    """Delimited bodies by language and source: `block` bytes of them or one longer text."""
    held, size = {}, 0
    for batch in batches:
        for lang, source, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "body")), strict=True):
            if size and size + len(body) > block:
                yield held
                held, size = {}, 0
            held.setdefault(lang, {}).setdefault(source, []).append(body.translate(TERMS))
            size += len(body)
    if held:
        yield held


def _same(value: str, n: int) -> pa.Array:
    return pa.repeat(pa.scalar(value, pa.string()), n)


def _documents_of_terms(block: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, block):
            for lang, sources in held.items():
                n = Counter()
                for bodies in sources.values():
                    for body in bodies:
                        n.update(set(body.split()))
                if n:
                    terms = pa.array(list(n.keys()), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([_same(lang, len(n)), terms, pa.array(list(n.values()), pa.int64())], ["lang", "term", "n"])

    return count


def vocabulary(rows: DataFrame, least: int = LEAST_DOCS, block: int = BLOCK) -> DataFrame:
    """lang and term of the terms that at least `least` documents of the language have."""
    counted = rows.mapInArrow(_documents_of_terms(block), "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _bit(lang: Column, term: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\0"), term).cast("binary")) % BITS


def bitmap(kept: DataFrame) -> np.ndarray:
    """BITS bits, set for the kept terms; at most BITS / BITMAP_BITS rows come to the driver."""
    placed = kept.select(_bit(F.col("lang"), F.col("term")).alias("bit")).select(F.floor(F.col("bit") / BITMAP_BITS).alias("row"), (F.col("bit") % BITMAP_BITS).alias("at"))
    out = np.zeros((BITS // BITMAP_BITS, BITMAP_BITS // 8), dtype=np.uint8)
    for r in placed.groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[r["row"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def _recount(kept: Broadcast, block: int) -> Callable:
    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        bits, number = kept.value, itemgetter(1)
        for held in _blocks(batches, block):
            for lang, sources in held.items():
                own = set()
                for bodies in sources.values():
                    for body in bodies:
                        own.update(body.split())
                own, start = list(own), zlib.crc32(f"{lang}\0".encode())
                places = np.fromiter((zlib.crc32(t, start) % BITS for t in own), dtype=np.int64, count=len(own))
                may = (bits[places >> 3] >> (places & 7)) & 1 == 1
                if not may.any():
                    continue
                terms = pa.array(own, pa.binary()).filter(pa.array(may)).cast(pa.string())
                automaton = ahocorasick.Automaton()
                for k, t in enumerate(terms.to_pylist()):
                    automaton.add_word(f" {t} ", k)
                automaton.make_automaton()
                for source, bodies in sources.items():
                    text = f" {b' '.join(bodies).decode()} "
                    n = np.bincount(np.fromiter(map(number, automaton.iter(text)), dtype=np.int64), minlength=len(terms))
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([_same(lang, len(at)), _same(source, len(at)), terms.take(pa.array(at)), pa.array(n[at], pa.int64())], ["lang", "source", "term", "count"])

    return recount


def postings(rows: DataFrame, kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, term and count (above 0) of kept terms, by automata."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap(kept))
    counted = rows.mapInArrow(_recount(sent, block), "lang string, source string, term string, count long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count")).join(kept, ["lang", "term"], "left_semi")


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)); in decimals where the product leaves a long."""
    div = lambda a, b: F.call_function("div", a, b)
    more = (count + 1).cast("long")
    wide = div(F.lit(SCALE).cast("decimal(10,0)") * more.cast("decimal(19,0)"), (n + v).cast("decimal(19,0)"))
    return F.when(n + v > 0, 1 + F.when(more < SCALE, div(F.lit(SCALE).cast("long") * more, n + v)).otherwise(wide))


def _stray(p: Column, q: Column) -> Column:
    """A long: shares are below 2^31. Over a vocabulary these sum to 10^9 (10^9 + V) + V at most, a long too."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = LEAST_DOCS, best: int = BEST_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module's text."""
    rows = prepared(docs)
    kept = C.durable(vocabulary(rows, least))
    found = C.durable(postings(rows, kept, block))

    # one row a group, with what its language holds
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    whole = found.groupBy("lang").agg(F.sum("count").alias("lang_n"))
    sums = found.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("n_terms"))
    groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(whole, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "n", "n_terms"])
    groups = C.durable(groups.withColumns({"p0": _share(F.lit(0), F.col("n"), F.col("v")), "group": F.struct("lang", "source")}))

    in_lang = W.partitionBy("lang", "term")  # a row a source
    told = C.join_counted(
        found.select(F.struct("lang", "source").alias("group"), "term", "count", F.sum("count").over(in_lang).alias("lang_count")),
        groups.filter("n_terms > 0").select("group", "v", "lang_n", "n", "n_terms", "p0"), "group", "n_terms",
    )
    told = C.durable(told.select(
        "group.lang", "group.source", "term", "p0", _share(F.col("count"), F.col("n"), F.col("v")).alias("p"), _share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q"),
    ))

    # pairs: what the terms of both add to what one-sided terms and the rest give
    a, b = told.alias("a"), told.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q_p"), F.col("p0").alias("q_p0"))
    both = (
        a.select("lang", "term", "source", "p", "p0").join(b.hint("merge"), ["lang", "term"]).filter("source != item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(_stray(F.col("p"), F.col("q_p")) - _stray(F.col("p"), F.col("q_p0")) - _stray(F.col("p0"), F.col("q_p")) + _stray(F.col("p0"), F.col("q_p0"))).alias("part"))
    )
    histogram = C.durable(told.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k")))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    one_sided = histogram.join(others, "lang").filter("source != other")
    of_source = one_sided.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(F.col("k") * _stray(F.col("p"), F.col("other_p0"))).alias("part"))
    of_item = one_sided.groupBy("lang", F.col("other").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("k") * _stray(F.col("other_p0"), F.col("p"))).alias("part"))
    g, h = groups.select("lang", "source", "v", "n_terms", "p0"), groups.select("lang", F.col("source").alias("item"), F.col("n_terms").alias("item_terms"), F.col("p0").alias("q_p0"))
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("n_terms") - F.col("item_terms")) * _stray(F.col("p0"), F.col("q_p0"))).otherwise(0)
    rest = g.join(h, "lang").filter("source != item").select("lang", "source", "item", neither.alias("part"))
    summed = rest.unionByName(both).unionByName(of_source).unionByName(of_item).groupBy("lang", "source", "item").agg(F.sum("part").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = summed.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})

    over = told.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _stray(F.col("p"), F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*names).unionByName(terms.select(*names))


def query(docs: DataFrame) -> DataFrame:
    return divergence(docs)


def oracle() -> str:
    """The same from counts of every source and kept term, zeros included."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
gp AS (SELECT lang, source, term, c, CAST(1 + ({SCALE}::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS HUGEINT) AS p FROM full_c JOIN v USING (lang)),
lp AS (SELECT lang, term, CAST(1 + ({SCALE}::HUGEINT * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS HUGEINT) AS q FROM full_c JOIN v USING (lang) GROUP BY 1, 2),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
every_pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM gp JOIN lp USING (lang, term) WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM every_pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= {BEST_TERMS}
"""
