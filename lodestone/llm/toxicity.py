"""Toxicity from two Kneser-Ney bigram models, one of toxic and one of ordinary texts.

Each class has discounted bigram counts that back off to its discounted continuation
counts (distinct words before a word), which back off to the continuation counts of
both classes together. The discount is large, so an expression must be seen more
than a few times before the classes differ on it; rare expressions stand on the
shared counts, and tell nothing. A text is compared by its log-likelihoods under the
two models, normalised by length: per word over the whole text, over its most toxic
window, over its few most toxic words, and by the excess of words that are far
likelier in one class. A logistic curve fitted on other labelled rows makes these a
probability.

Labels are learnt from rows whose crc32 of the id is not 0 modulo 5: remainders 2, 3
and 4 give counts, remainder 1 the curve. `SAMPLE` rows a class and purpose at most,
in hash order, are read for it; that bounds the model, which is broadcast. All rows
are scored, whole.

Defined results: a null or empty text scores what the curve gives for no evidence;
rows without a label, or with one for no document, teach nothing; of rows that
repeat an id the least text is learnt from; a document labelled twice is toxic if one label says so; null ids are scored, held out false;
without labels of both classes every score is the share of toxic labels, or 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fitting import logistic

FOLDS = 5
SAMPLE = 4000
DISCOUNT = 4.0
WINDOW = 6
TOP = 3
STRIP = ".,;:!?\"'()[]{}<>|&%$#*~_-"
CURVE_FEATURES = 4


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


_WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text: str | None) -> list[str]:
    """Lowered words without the marks around them; training and scoring share this."""
    return [t for w in _WORD.findall((text or "").lower()) if (t := w.strip(STRIP))]


def labelled(docs: DataFrame, labels: DataFrame, of_folds: tuple[int, ...], sample: int) -> DataFrame:
    """text and toxic of at most `sample` labelled documents a class; the labels are broadcast."""
    known = labels.filter(F.col("toxic").isin(0, 1) & fold(F.col("doc_id")).isin(*of_folds))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    some = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(sample) for c in (0, 1)]
    met = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min(C.text_or_empty(F.col("text"))).alias("text")).select("text", "toxic")


class Model:
    """Discounted counts as arrays: words with unigram probabilities by class, bigrams with theirs."""

    def __init__(self, bigrams: pd.DataFrame, words: pd.DataFrame):
        """`bigrams`: a, b, toxic, n above the discount. `words`: w, toxic, n (as a history), c (continuations)."""
        listed = sorted(set(words["w"]))
        self.ids = {w: k for k, w in enumerate(listed)}
        size = len(listed) + 1  # the last is any other word
        history, follow = np.zeros((2, size)), np.zeros((2, size))
        at = words["w"].map(self.ids).to_numpy(dtype=np.int64)
        side = words["toxic"].to_numpy(dtype=np.int64)
        history[side, at], follow[side, at] = words["n"], words["c"]
        shared = follow.sum(0) + 0.5
        shared /= shared.sum()
        kept = np.maximum(follow - DISCOUNT, 0.0)
        total = np.maximum(follow.sum(1, keepdims=True), 1.0)
        self.unigram = kept / total + (1 - kept.sum(1, keepdims=True) / total) * shared
        a, b = (bigrams[c].map(self.ids).to_numpy(dtype=np.int64) for c in ("a", "b"))
        side, n = bigrams["toxic"].to_numpy(dtype=np.int64), bigrams["n"].to_numpy(dtype=float) - DISCOUNT
        keys = a * size + b
        self.keys, where = np.unique(keys, return_inverse=True)
        self.extra = np.zeros((2, len(self.keys)))
        self.extra[side, where] = n / np.maximum(history[side, a], 1.0)
        self.rest = np.ones((2, size))
        np.subtract.at(self.rest, (side, a), n / np.maximum(history[side, a], 1.0))
        self.rest = np.maximum(self.rest, 1e-3)
        self.size = size

    def ratios(self, text: str | None) -> np.ndarray:
        """log P(toxic model) - log P(ordinary model) of each token."""
        at = np.array([self.ids.get(t, self.size - 1) for t in tokens(text)], dtype=np.int64)
        if not len(at):
            return np.empty(0)
        p = self.unigram[:, at]
        if len(self.keys) and len(at) > 1:
            p[:, 1:] *= self.rest[:, at[:-1]]
            key = at[:-1] * self.size + at[1:]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            p[:, 1:][:, hit] += self.extra[:, k[hit]]
        return np.log(p[1] / p[0])

    def features(self, text: str | None) -> tuple[float, ...]:
        """Means over the text, its most toxic window and its TOP most toxic words; scaled excess over 1."""
        r = self.ratios(text)
        n = len(r)
        if not n:
            return (0.0,) * CURVE_FEATURES
        sums = np.concatenate(([0.0], np.cumsum(r)))
        width = min(WINDOW, n)
        window = (sums[width:] - sums[:-width]).max() / WINDOW
        return r.mean(), window, np.partition(r, max(0, n - TOP))[-TOP:].mean(), np.maximum(r - 1, 0).sum() / np.sqrt(n)


def train(sample: DataFrame) -> Model:
    """Counts by grouping, of a bounded sample; what passes the discount comes to the driver."""
    said = F.pandas_udf(lambda texts: texts.map(tokens), "array<string>")
    rows = C.durable(sample.select("toxic", said("text").alias("words")))
    pairs = rows.select("toxic", F.explode(F.arrays_zip(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("a"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("b"))).alias("p"))
    counts = C.durable(pairs.groupBy("toxic", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")))
    history = counts.groupBy("toxic", F.col("a").alias("w")).agg(F.sum("n").alias("n"))
    follow = counts.groupBy("toxic", F.col("b").alias("w")).agg(F.count(F.lit(1)).alias("c"))
    words = history.join(follow, ["toxic", "w"], "full").fillna(0)
    # words that neither class holds above the discount stand on the shared counts, as unknown ones do
    often = follow.groupBy("w").agg(F.max("c").alias("c")).filter(F.col("c") > DISCOUNT).select("w")
    above = counts.filter(F.col("n") > DISCOUNT)
    above = above.join(often.withColumnRenamed("w", "a"), "a", "left_semi").join(often.withColumnRenamed("w", "b"), "b", "left_semi")
    return Model(above.select("a", "b", "toxic", "n").toPandas(), words.join(often, "w", "left_semi").toPandas())


def _featured(model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model.value
        for frame in frames:
            rest = frame.drop(columns=["text"])
            f = np.array([own.features(t) for t in frame["text"]]).reshape(-1, CURVE_FEATURES)
            yield rest.assign(**{f"f{k}": f[:, k] for k in range(CURVE_FEATURES)})

    return run


FEATURE_TYPES = ", ".join(f"f{k} double" for k in range(CURVE_FEATURES))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, log_ratio and predicted of each row of `docs` (doc_id, text).

    log_ratio is the plain comparison: the two log-likelihoods' difference a word.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    totals = {r["toxic"]: r["n"] for r in labels.filter("toxic in (0, 1)").filter(fold(F.col("doc_id")) != 0).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    model = train(labelled(docs, labels, (2, 3, 4), sample)) if len(totals) == 2 else None
    if model is None:
        scored = docs.select("doc_id", held.alias("held_out"), F.lit(float(share)).alias("score"), F.lit(0.0).alias("log_ratio"))
    else:
        sent = spark.sparkContext.broadcast(model)
        curve = labelled(docs, labels, (1,), sample).mapInPandas(_featured(sent), f"toxic int, {FEATURE_TYPES}").toPandas()
        x, y = curve[[f"f{k}" for k in range(CURVE_FEATURES)]].to_numpy(), curve["toxic"].to_numpy(dtype=float)
        if len(set(y)) == 2:
            weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
            spread = np.maximum(x.std(0), 1e-9)
            beta = logistic(x / spread, y, weight)
            beta[:-1] /= spread
        else:
            beta = np.array([0.0, 0.0, 1.0, 0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3))])
        rows = docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), F.col("text").cast("string"))
        featured = rows.mapInPandas(_featured(sent), f"doc_id long, held_out boolean, {FEATURE_TYPES}")
        logit = sum((F.col(f"f{k}") * float(beta[k]) for k in range(CURVE_FEATURES)), F.lit(float(beta[-1])))
        scored = featured.select("doc_id", "held_out", (1 / (1 + F.exp(-logit))).alias("score"), F.col("f0").alias("log_ratio"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
