"""Corpus cleaning as stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontamination, line_dedup, mixing, near_dedup, quality_rules


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand earlier elsewhere; those of which nothing is left go."""
    return line_dedup.without_repeats(docs, keep_emptied=False)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return near_dedup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each epoch of a document that is taken, with epoch and taken_words."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", reject_poor),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The stages iterate and align, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
