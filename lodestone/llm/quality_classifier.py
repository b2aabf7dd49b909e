"""Quality by hierarchical empirical Bayes: document, path and host evidence.

A logistic classifier over measured features, fitted on at most `SAMPLE` labelled
rows, gives each document a probability and, against the share of good labels, a log
likelihood ratio. Grouped sums of the probabilities give every host a beta
posterior whose prior mean is the global one, and every path one whose prior mean is
its host's. The weights of the priors are method-of-moments estimates from the
spread between hosts, and between paths of one host, beyond what sampling explains:
a site with few documents is drawn to the prior, one with many stands on its own.
The document's ratio then moves its path's posterior mean, from which its own
probability is left out at both levels: it is counted once.

Defined results: a null text has no words and takes the features of an empty one; a
null host or path is one of its own; rows that repeat count and are scored one by
one; a document labelled twice is good if one label says so; of rows that repeat an
id the one with the least features is learnt from; labels for no document, or null ones, teach nothing; without labels of both
kinds the classifier is neutral and every document stands at the share of good
labels (0.5 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import quality_rules
from .fitting import logistic

SAMPLE = 20_000
#: Bounds of the prior weights, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0
KEEP_AT = 0.5
BROADCAST_ROWS = 1_000_000


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first part of the path of a URL."""
    return F.lower(F.regexp_extract(url, "^[a-zA-Z]+://(?:www\\.)?([^/?#:]+)", 1)), F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+/?([^/?#]*)", 1)


def _ratios() -> list[Column]:
    share = lambda a, b, most: F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(most))
    return [
        share("n_symbols", "n_words", 0.5),
        share("n_marked_words", "n_words", 0.5),
        share("n_upper_words", "n_words", 0.5),
        share("word_chars", "n_words", 20.0),
        share("n_dup_lines", "n_lines", 1.0),
        share("n_repeat_words", "n_words", 1.0),
        share("n_letters", "word_chars", 1.0),
        F.least(F.log1p("n_words"), F.lit(6.0)),
        F.when(F.col("n_words") < quality_rules.MIN_WORDS, 1.0).otherwise(0.0),
    ]


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and x, the features, of each row of `docs` (doc_id, text, ...)."""
    rows = docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path"))
    return C.durable(quality_rules.features(rows).select("doc_id", "host", "path", F.array(*_ratios()).alias("x")))


def classifier(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray | None, float]:
    """Weights over x, the last the intercept, and the share of good labels."""
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(sample)
    share = known.agg(F.avg("quality")).first()[0]
    got = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    y = got["quality"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None, 0.5 if share is None else float(share)
    x = np.stack(got["x"].to_numpy()).astype(float)
    spread = np.maximum(x.std(0), 1e-9)
    beta = logistic(x / spread, y, np.ones(len(y)))
    beta[:-1] /= spread
    return beta, float(share)


def _weight(groups: DataFrame, mean: Column) -> float:
    """Prior weight k of beta posteriors around `mean`, from rows (s, q, n): sums of p, of p squared, and counts.

    The spread of group means is the spread between groups plus that of sampling.
    """
    within = F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))
    rows = groups.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("a"),
        F.sum(within).alias("w"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("v"),
    )
    got = rows.first()
    if not got["n"]:
        return MOST_WEIGHT
    between = max((got["a"] - got["w"]) / got["n"], 0.0)
    return float(min(MOST_WEIGHT, max(LEAST_WEIGHT, got["v"] / got["n"] / between - 1 if between > 0 else MOST_WEIGHT)))


def quality_classifier(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, p_doc, p_host, p_path, p_good, kept of each row of `docs`."""
    rows = measured(docs, host, path)
    beta, share = classifier(rows, labels)
    share = min(max(share, 0.01), 0.99)
    base = float(np.log(share / (1 - share)))
    if beta is None:
        logit = F.lit(base)
    else:
        logit = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta[:-1]]), lambda a, b: a * b), F.lit(float(beta[-1])), lambda a, b: a + b)
    logit = F.greatest(F.least(logit, F.lit(20.0)), F.lit(-20.0))
    rated = rows.select("doc_id", "host", "path", logit.alias("logit")).withColumn("p_doc", 1 / (1 + F.exp(-F.col("logit"))))
    per_path = C.durable(rated.groupBy("host", "path").agg(F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q"), F.count(F.lit(1)).alias("n")))
    per_host = C.durable(per_path.groupBy("host").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")))
    whole = per_host.agg(F.sum("s"), F.sum("n")).first()
    mean = whole[0] / whole[1] if whole[1] else share
    k_host = _weight(per_host, F.lit(mean))
    hosts = per_host.select(F.col("host").alias("h"), ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("p_host"), F.col("s").alias("host_s"), F.col("n").alias("host_n"))
    paths = per_path.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    k_path = _weight(paths, F.col("p_host"))
    sites = C.durable(paths.select("h", F.col("path").alias("p"), "p_host", ((F.col("s") + k_path * F.col("p_host")) / (F.col("n") + k_path)).alias("p_path"), "s", "n", "host_s", "host_n"))
    if C.bounded(sites, BROADCAST_ROWS):
        sites = F.broadcast(sites)
    met = rated.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    of_host = (F.col("host_s") - F.col("p_doc") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    of_path = (F.col("s") - F.col("p_doc") + k_path * of_host) / (F.col("n") - 1 + k_path)
    prior = F.greatest(F.least(of_path, F.lit(0.999)), F.lit(0.001))
    p_good = 1 / (1 + F.exp(-(F.col("logit") - base + F.log(prior / (1 - prior)))))
    return met.select("doc_id", "host", "path", "p_doc", "p_host", "p_path", p_good.alias("p_good")).withColumn("kept", F.col("p_good") >= KEEP_AT)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` by source as host and language as path."""
    found = quality_classifier(docs, labels.select("doc_id", "quality"), F.col("source"), F.col("lang"))
    return found.select("doc_id", "host", "path", *[F.round(c, 6).alias(c) for c in ("p_doc", "p_host", "p_path", "p_good")], "kept")
