"""Predicates of reads: built only from what a caller sets, so that each reaches the scan."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ_KEYS = ("since", "until", "source_id", "source_family", "contains", "is")


def optional(column: Column, op: str, value) -> Column:
    """`column op value`, or true where no value is set."""
    if value is None:
        return F.lit(True)
    return {"=": column == value, ">=": column >= value, "<=": column <= value, "in": column.isin(*value) if op == "in" else None}[op]


def instant(value: str | date | datetime) -> Column:
    """A moment in UTC without zone; a bare date is its midnight."""
    return F.lit(str(value)).cast("timestamp_ntz")


def read_filters(df: DataFrame, filters: dict, columns: dict[str, str]) -> DataFrame:
    """`df` under `filters`, time bounds inclusive; `columns` maps keys to columns, unknown keys are refused."""
    unknown = sorted(set(filters) - set(READ_KEYS))
    if unknown:
        raise ValueError(f"unknown filters: {unknown}")
    for key, value in filters.items():
        if value is None:
            continue
        col = F.col(columns[key])
        if key == "since":
            df = df.filter(col >= instant(value))
        elif key == "until":
            df = df.filter(col <= instant(value))
        elif key == "contains":
            df = df.filter(F.contains(F.lower(col), F.lit(value.lower())))
        else:
            df = df.filter(col.isin(*value) if isinstance(value, list | tuple) else col == value)
    return df


def overlaps(first: Column, last: Column, since, until) -> Column:
    """Whether [first, last] and [since, until] meet; a bound that is not set is open."""
    return optional(last, ">=", None if since is None else instant(since)) & optional(first, "<=", None if until is None else instant(until))


def live_only(documents: DataFrame, receipts: DataFrame, live: DataFrame, key: str, receipt: str) -> DataFrame:
    """`documents` all of whose `receipts` are in `live`: no receipt may be missing there."""
    dead = receipts.join(live, receipt, "left_anti")
    return documents.join(dead.select(key).distinct(), key, "left_anti")


def latest_unless_tombstone(log: DataFrame, keys: list[str], revision: str, tombstone: str) -> DataFrame:
    """The last revision of each key, unless it is a tombstone."""
    row = F.struct(revision, *[c for c in log.columns if c not in (*keys, revision)])
    last = log.groupBy(*keys).agg(F.max_by(row, revision).alias("r")).select(*keys, "r.*")
    return last.filter(~F.col(tombstone)).select(*log.columns)


RELATIVE = r"(?i)\blast\s+(\d+)\s+(hour|day|week)s?\b"
MOST_UNITS = 365


def relative_window(question: Column, now: Column) -> tuple[Column, Column]:
    """Bounds that a question names: today, yesterday, or the last N hours, days or weeks; null if none."""
    n = F.least(F.regexp_extract(question, RELATIVE, 1).try_cast("int"), F.lit(MOST_UNITS))
    unit = F.lower(F.regexp_extract(question, RELATIVE, 2))
    hours = n * F.when(unit == "hour", 1).when(unit == "day", 24).when(unit == "week", 168)
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    yesterday, today = (F.contains(F.lower(question), F.lit(w)) for w in ("yesterday", "today"))
    since = F.when(yesterday, day - F.expr("INTERVAL 1 DAY")).when(today, day).otherwise(now - F.make_dt_interval(hours=hours))
    until = F.when(yesterday, day).otherwise(F.when(today | hours.isNotNull(), now))
    return since, until
