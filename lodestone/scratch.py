"""Shared scratch space: where intermediate tables and stream state go."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; on a local master that names none, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lodestone-"))
    return _own[0]


def new_path(spark: SparkSession) -> str:
    """A path of its own in the scratch folder; what is there goes when the Python process ends."""
    path = f"{scratch_dir(spark)}/lodestone/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the scratch folder and read back.

    Lineage ends there: a lost executor costs a reread and no recomputation.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already; then the cluster's own clean-up applies
            return
