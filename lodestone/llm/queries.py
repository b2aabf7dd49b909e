"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import (
    decontamination,
    divergence,
    language_model,
    line_dedup,
    mixing,
    near_dedup,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_counts,
    toxicity,
)


def _over_documents(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _over_documents(quality_rules.query),
        "op2_quality_classifier": lambda spark, d: quality_classifier.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op3_near_dedup": _over_documents(near_dedup.query),
        "op4_decontamination": lambda spark, d: decontamination.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op5_line_dedup": _over_documents(line_dedup.query),
        "op6_secret_scan": _over_documents(secret_scan.query),
        "op7_mixing": _over_documents(mixing.query),
        "op8_language_model": _over_documents(language_model.query),
        "op9_toxicity": lambda spark, d: toxicity.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_substring_dedup": _over_documents(substring_dedup.query),
        "op11_periodic_runs": _over_documents(periodic_runs.query),
        "op12_token_counts": _over_documents(token_counts.query),
        "op13_source_divergence": _over_documents(divergence.query),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_near_dedup": near_dedup.oracle(),
        "op5_line_dedup": line_dedup.oracle(),
        "op6_secret_scan": secret_scan.oracle(),
        "op7_mixing": mixing.oracle(),
        "op13_source_divergence": divergence.oracle(),
    }
