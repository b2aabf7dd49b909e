"""The registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import derived, evidence, ingest, lifecycle, relational, search, searching, sequence, storage, streams, text, tools

_MODULES = (relational, sequence, text, search, searching, ingest, derived, evidence, lifecycle, storage, streams, tools)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
