"""An open SQL surface over named views: one read-only statement, whose caller is told if there are more rows than it gives."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_CHARS = 16_384
MOST_ROWS = 10_000


def run_program(spark: SparkSession, program: str, views: dict[str, DataFrame], most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of `program`, a SELECT over `views` alone, at most `most_rows` of them, and in each `complete`: whether
    these are all. The views are gone afterwards; a program may not have a column `complete`.

    Spark's own parser reads the statement. Commands are refused, and so is every
    relation that is neither a view nor one of the statement's own WITH names.
    """
    if len(program) > MOST_CHARS:
        raise ValueError("program is too long")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(program)
    shape = plan.toString()
    if re.search(r"Command|InsertInto|CreateTable|CreateView|DropTable|SetCatalog|CacheTable|Unresolved(?:Table|View)\b|'?(?:Delete|Update|Merge)From|ScriptTransformation", shape):
        raise ValueError("only SELECT is allowed")
    named = set(re.findall(r"'UnresolvedRelation \[([^\]]*)\]", shape))
    own = set(re.findall(r"(?i)(?:\bwith|,)\s+(?:recursive\s+)?([a-z_]\w*)\s*(?:\([^)]*\)\s*)?as\s*\(", program))
    if outside := sorted(n for n in named if n not in views and n not in own):
        raise ValueError(f"unknown relations: {outside}")
    if re.search(r"(?i)\b(?:reflect|java_method|try_reflect|read_files)\s*\(|`[^`]*[/:]", program):
        raise ValueError("only the views may be read")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        rows = spark.sql(program)  # names are resolved here, so the views need not stay
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
    if "complete" in (c.lower() for c in rows.columns):
        raise ValueError("the column complete is the surface's own")
    held = rows.limit(most_rows + 1)  # the window is over that many rows at most
    return held.withColumn("complete", F.count(F.lit(1)).over(W.partitionBy()) <= most_rows).limit(most_rows)
