"""Remote paged collections as a Python data source, read by batch or as a stream.

`fetch(cursor, limit)` gives (records, next cursor or None), from any API or, in
tests, from memory; the cursor is the stream's offset, so a restart goes on where the
last committed batch ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

MOST_RECORDS = 500


def pages(fetch: Callable, cursor: str | None = None) -> Iterator[tuple[list[dict], str | None]]:
    """Pages from `cursor` on; a cursor that comes twice is an error."""
    seen = set()
    while True:
        records, following = fetch(cursor, MOST_RECORDS)
        if len(records) > MOST_RECORDS:
            raise ValueError("page is too large")
        yield records, following
        if following is None:
            return
        if following in seen:
            raise ValueError("cursor came twice")
        seen.add(following)
        cursor = following


def _rows(records: list[dict]) -> Iterator[tuple]:
    for r in records:
        yield str(r.get("id", "")), json.dumps(r, sort_keys=True, ensure_ascii=False)


def register(spark: SparkSession, name: str, fetch: Callable) -> None:
    """Makes `spark.read.format(name)` and `spark.readStream.format(name)` read what `fetch` gives: id, record (JSON)."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(None)]

        def read(self, partition):
            for records, _ in pages(fetch):
                yield from _rows(records)

    class Stream(SimpleDataSourceStreamReader):
        def initialOffset(self):  # noqa: N802
            return {"cursor": ""}

        def read(self, start):
            cursor = start["cursor"]
            if cursor == "end":
                return iter([]), start
            records, following = fetch(cursor or None, MOST_RECORDS)
            return _rows(records), {"cursor": following or "end"}

        def readBetweenOffsets(self, start, end):  # noqa: N802
            cursor = start["cursor"]
            while cursor not in (end["cursor"], "end"):
                records, following = fetch(cursor or None, MOST_RECORDS)
                yield from _rows(records)
                cursor = following or "end"

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "id string, record string"

        def reader(self, schema):
            return Reader()

        def simpleStreamReader(self, schema):  # noqa: N802
            return Stream()

    spark.dataSource.register(Paged)
