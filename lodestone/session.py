"""SparkSession defaults for local runs; on a cluster the session comes configured."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "lodestone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution, for tests and local benchmarks."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
