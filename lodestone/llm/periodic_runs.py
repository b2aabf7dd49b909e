"""Periodic runs: stretches of words that repeat with a period, by a harmonic grid of extensions.

A run is a maximal stretch with smallest period p that is at least 2p words long. It
holds two neighbours jp and (j+1)p of the grid of multiples of p. So for each p the
pairs of neighbours are asked how far the words from them on agree (forward) and how
far the words before them agree (backward); where the two together reach p, a run is
found, with its bounds. There are n/p pairs a period, n log n a document.

Extensions are longest common prefixes of suffixes: a suffix array by prefix doubling
with its LCP array and a table of range minima answers each in constant time, and
those of the reversed words answer backwards. Pairs whose first words differ have no
extension and are not asked. A run shows under multiples of its period with the same
bounds; the least period counts.

Documents of an Arrow batch are worked on together, up to `BATCH` words at once or one
longer document, so small ones cost no arrays of their own. Memory is about 400 bytes
a word of that; extensions are asked `PAIRS` at a time.

Defined results: a null, empty or wordless text has no run and collapses to ''; runs
of a text do not depend on other rows; null ids stay; an empty table gives an empty
result; columns that clash with `runs` and `collapsed` are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST = 12
BATCH = 1 << 18
PAIRS = 1 << 20
_WORD = re.compile("[^\x20\x09-\x0d]+")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Extensions:
    """Longest common prefixes of any two suffixes of `codes` (from 0, small), by suffix array, LCP array and range minima."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        # the rank of a suffix is the place of the first that begins with the same 2^t codes; one of no codes is last
        first = np.append(np.cumsum(np.bincount(codes)), 0).astype(np.int32)
        rank = np.append(first[codes - 1], np.int32(-1)) if n else np.array([-1], dtype=np.int32)
        ranks, h = [rank], 1
        open_ = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
        while len(open_):  # only suffixes that share their rank are sorted on, by their next codes
            key = rank[open_].astype(np.int64) * (n + 1) + rank[np.minimum(open_ + h, n)] + 1
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            group = key // (n + 1)
            at = np.arange(len(key))
            starts = np.concatenate([[True], np.diff(group) != 0])
            new = np.concatenate([[True], np.diff(key) != 0])
            place = group + at - np.maximum.accumulate(np.where(starts, at, 0))
            rank = rank.copy()
            rank[open_] = place[np.maximum.accumulate(np.where(new, at, 0))]
            ranks.append(rank)
            alone = new & np.append(new[1:], True)
            open_ = open_[~alone]
            h *= 2
        self.place = rank
        order = np.empty(n, dtype=np.int64)
        order[rank[:n]] = np.arange(n)
        # neighbours agree in the first 2^t codes where their ranks of round t do: the longest lengths first
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), dtype=np.int32)
        for t in range(len(ranks) - 2, -1, -1):
            same = np.flatnonzero(ranks[t][a] == ranks[t][b])
            a[same] += 1 << t
            b[same] += 1 << t
            common[same] += 1 << t
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            last, w = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-w], last[w:]))

    def between(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Codes that the suffixes at `i` and `k` (elsewhere, inside) begin with in common."""
        a, b = self.place[i], self.place[k]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), dtype=np.int32)
        for t in np.unique(level):
            at = np.flatnonzero(level == t)
            out[at] = np.minimum(self.least[t][low[at]], self.least[t][high[at] - (1 << t)])
        return out


def _grid(begins: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """period, place and place + period of neighbours of the grids of all documents where the codes agree."""
    periods = sizes // 2
    doc = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (sizes[doc] - 1) // period
    upto = np.cumsum(pairs)
    first = 0
    while first < len(doc):
        stop = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
        n = pairs[first:stop]
        p = np.repeat(period[first:stop], n)
        j = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        i = np.repeat(begins[doc[first:stop]], n) + j * p
        same = np.flatnonzero(codes[i] == codes[i + p])
        yield p[same], i[same], i[same] + p[same]
        first = stop


def _once(start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of bounds once, with its least period."""
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    new = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])[: len(p)]
    return start[new], end[new], p[new]


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (after it) and period of the runs of documents whose word codes stand one after another with one
    place between them; by start, then period. The codes of the places between are no words', and no two equal."""
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    n, after, found = len(codes), None, []
    for p, i, k in _grid(begins, sizes, codes):
        if not len(p):
            continue
        if after is None:
            after, before = Extensions(codes), Extensions(codes[::-1].copy())
        end, start, inner = k + after.between(i, k), i.copy(), np.flatnonzero(i > 0)
        start[inner] -= before.between(n - i[inner], n - k[inner])
        run = np.flatnonzero((end - start >= 2 * p) & (end - start >= least))
        found.append(_once(start[run], end[run], p[run]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    start, end, p = _once(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _of_texts(texts: list[str | None], least: int) -> tuple[np.ndarray, ...]:
    """Runs a document, start, length and period of all of them, and the collapsed texts."""
    words = [_WORD.findall(t or "") for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.empty(begins[-1], dtype=np.int64)
    said = np.ones(len(codes), dtype=bool)
    said[begins[1:] - 1] = False
    codes[said], known = pd.factorize(np.array([w for own in words for w in own], dtype=object))
    codes[~said] = len(known) + np.arange(len(words))
    start, end, period = find_runs(codes, sizes, least)
    doc = np.searchsorted(begins, start, side="right") - 1
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change)[:-1] == 0
    collapsed = [" ".join(w) for w in words]
    for d in np.unique(doc):
        own = kept[begins[d] : begins[d] + sizes[d]]
        collapsed[d] = " ".join([w for w, k in zip(words[d], own, strict=True) if k])
    return np.bincount(doc, minlength=len(words)), start - begins[doc], end - start, period, collapsed


def _runs_of(least: int, at_once: int) -> Callable:
    def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
        held, size = [], 0
        for t in texts:
            n = len(t or "") // 4  # words of a text, roughly; a batch is about so many
            if held and size + n > at_once:
                yield held
                held, size = [], 0
            held.append(t)
            size += n
        if held:
            yield held

    @F.arrow_udf(f"struct<runs:{RUNS},collapsed:string>")
    def runs_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            once = batch.dictionary_encode(null_encoding="encode")  # copies in a batch are worked on once
            counts, starts, lengths, periods, collapsed = [], [], [], [], []
            for held in groups(once.dictionary.to_pylist()):
                for into, part in zip((counts, starts, lengths, periods, collapsed), _of_texts(held, least), strict=True):
                    into.append(part)
            one = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (starts, lengths, periods)]
            upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
            runs = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in one], ["start", "length", "period"]))
            found = pa.StructArray.from_arrays([runs, pa.array([c for part in collapsed for c in part], pa.string())], ["runs", "collapsed"])
            yield found.take(once.indices)

    return runs_of


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, batch: int = BATCH) -> DataFrame:
    """`docs` with `runs` of its texts (start, length and period in words, by start, then period) and `collapsed`,
    the words but for those that a run repeats, with single spaces."""
    names = C.without(docs, "runs", "collapsed").columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), _runs_of(least, batch)(F.col(f"`{text}`").cast("string")).alias("found"))
    return rows.select(*[F.col("row")[c].alias(c) for c in names], F.col("found.runs").alias("runs"), F.col("found.collapsed").alias("collapsed"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text; in a tenth of the documents, by crc32 of the id, a period repeats from a place on (null ids: in none)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewrite(w: Column) -> Column:
        n = F.size(w)
        return C.let(g % n, lambda a: C.let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(
            F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")))

    return F.when((h % 10 == 0) & F.rlike(C.text_or_empty(text), F.lit(C.HAS_WORD)), C.let(C.words(text), rewrite)).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
