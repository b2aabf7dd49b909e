"""Rows of SQLite files, each read from its own bytes as one snapshot."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def read_sqlite(spark: SparkSession, root: str, query: str, schema: str, pattern: str = "*.{db,sqlite}") -> DataFrame:
    """What `query` gives in each file below `root`, with its `path`; `schema` names the query's columns and types."""
    names = [c.split()[0] for c in schema.split(",")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(raw))
                db.execute("PRAGMA query_only = 1")
                cursor = db.execute(query)
                while rows := cursor.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=names).assign(path=path)[["path", *names]]
                db.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInPandas(read, f"path string, {schema}")
