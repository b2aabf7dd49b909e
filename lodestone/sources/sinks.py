"""Month datasets in Parquet, and the life of stored rows: replace, skip, prune, forget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_A_FILE = 1_000_000
#: Unchanged partitions up to which their keys are broadcast.
MOST_BUCKETS = 100_000


def month_rows(df: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each month that [first, last] touches, as `bucket`; readers of two months drop repeats by id."""
    return df.withColumn("bucket", F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))))


def digests(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_rows and digest of what each partition holds, whatever the order of its rows."""
    row = F.xxhash64(*[c for c in df.columns if c not in keys]).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).cast("string").alias("digest"))


def changed_only(df: DataFrame, keys: list[str], stored: DataFrame | None) -> DataFrame:
    """Rows of the partitions whose digest is not the stored one."""
    if stored is None:
        return df
    now = digests(df, keys)
    same = now.join(stored, [*keys, "n_rows", "digest"]).select(*keys)
    return df.join(F.broadcast(same) if same.count() <= MOST_BUCKETS else same, keys, "left_anti")


def write_partitions(df: DataFrame, path: str, keys: list[str], rows_a_file: int = ROWS_A_FILE) -> None:
    """Replaces the partitions of `path` that `df` has rows for, and no others."""
    writer = df.repartition(*keys, F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(8))).write.mode("overwrite").partitionBy(*keys)
    writer.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_a_file).option("compression", "zstd").parquet(path)


def orphans(artifacts: DataFrame, *references: DataFrame) -> DataFrame:
    """Artifacts (artifact) that none of the references names."""
    named = references[0].select("artifact")
    for r in references[1:]:
        named = named.union(r.select("artifact"))
    return artifacts.join(named.distinct(), "artifact", "left_anti")


def prune(df: DataFrame, state: str, terminal: list[str], updated: str, before) -> DataFrame:
    """`df` without rows in a terminal state that were last touched before `before`."""
    return df.filter(~(F.col(state).isin(*terminal) & (F.col(updated) < F.lit(before))))


def export_page(df: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """The next `limit` rows in order after the key `after`, and one more to tell whether there are more."""
    rows = df if after is None else df.filter(F.struct(*order) > F.struct(*[F.lit(v) for v in after]))
    return rows.orderBy(*order).limit(limit + 1)
