"""Streaming ingest on keyed state: a batch costs what it holds, however long the log is.

The state of a key (source, native_id) is one row, its last revision and its first
INLINE content hashes, and a row for each further hash. A content seen before is a replay and
gives no row; new contents of a batch are numbered by (arrival, hash) after the last revision, as
`operators.ingest.new_revisions` does over the whole log. Needs the RocksDB state store, which
`start` names for the session.

Keys are dealt to BUCKETS groups, a fixed part of the checkpoint, so that a call serves many keys: a key costs
one read and one write of state, and hashes beyond INLINE one of each. A group's rows of a batch come in Arrow pieces;
what is held of them is one row a new content, and the states of its keys. Revisions are the same however events are dealt
to batches, if each key's events come in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import ingest
from .ingest import LOG

COLUMNS = [c.split()[0] for c in LOG.split(", ") if not c.startswith("batch ")]
ROWS = ", ".join(c for c in LOG.split(", ") if not c.startswith("batch "))
BUCKETS, INLINE = 1024, 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Revisions(StatefulProcessor):
    """New contents of the keys of a bucket with their revisions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "source string, native_id string", "revision int, first array<string>")
        self.seen = handle.getMapState("seen", "source string, native_id string, sha256 string", "revision int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known: dict[tuple, tuple[int, list[str]]] = {}
        fresh: set[tuple] = set()
        new = pd.DataFrame()
        for piece in rows:
            first = pd.concat([new, piece]).sort_values(["arrival", "sha256"]).drop_duplicates([*ingest.KEY, "sha256"])
            new = first[[self._is_new(k, known, fresh) for k in zip(first["source"], first["native_id"], first["sha256"], strict=True)]]
        if new.empty:
            return
        revisions = []
        for source, native_id, h in zip(new["source"], new["native_id"], new["sha256"], strict=True):
            n, held = known[source, native_id]
            known[source, native_id] = (n + 1, [*held, h] if n < INLINE else held)
            revisions.append(n + 1)
            if n >= INLINE:
                self.seen.updateValue((source, native_id, h), (n + 1,))
        for k in dict.fromkeys(zip(new["source"], new["native_id"], strict=True)):
            self.last.updateValue(k, known[k])
        yield new.assign(revision=revisions)[COLUMNS].reset_index(drop=True)

    def _is_new(self, content: tuple, known: dict, fresh: set) -> bool:
        if content in fresh:
            return True
        own = content[:2]
        if own not in known:
            state = self.last.getValue(own)
            known[own] = (state[0], list(state[1])) if state is not None else (0, [])
        n, held = known[own]
        if content[2] in held or n > INLINE and self.seen.containsKey(content):
            return False
        fresh.add(content)
        return True

    def close(self) -> None:
        pass


def revisions(events: DataFrame, forgotten: DataFrame | None = None) -> DataFrame:
    """The stream of new revisions of a stream of events; forgotten keys (a stored table) give none."""
    if forgotten is not None:
        events = ingest.without_forgotten(events, forgotten)
    bucket = F.pmod(F.xxhash64(*ingest.KEY), F.lit(BUCKETS)).cast("int").alias("bucket")
    hashed = ingest.with_content_hash(events).select(bucket, *[c for c in COLUMNS if c != "revision"])
    return hashed.groupBy("bucket").transformWithStateInPandas(Revisions(), ROWS, "Append", "None")


def start(events: DataFrame, path: str, checkpoint: str, forgotten: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Runs `events` into the log at `path`, a folder a batch; a batch that is run again replaces its own rows."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def write(batch: DataFrame, k: int) -> None:
        rows = batch.withColumn("batch", F.lit(k).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return revisions(events, forgotten).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
