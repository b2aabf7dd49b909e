"""JSON-line files as a data source that goes on by byte offsets: `format("json_line_files")`.

As a batch it gives the complete lines of all files below `path`; as a stream it gives
what changed since the last batch. What the stream knows of the files stands in a
manifest a generation (one row a file: path, size, time, version, bytes read, fingerprint,
gone) in the folder `manifests`; the stream's offset is the generation, so its log stays
small however many files there are.

Rows are (path, version, change, start, raw). A line has `start`, the place of its first
byte, and `raw` without its end. Each change of a file gives a row without them as well:

- new, rewrite: the file is read from its start, under the next version;
- append: the bytes known before are still there, so the lines after them follow under
  the same version;
- tombstone, restore: the file went, or came back as it was.

The lines of a file that count are those of its highest version (`live_lines`). A file
is as it was if its size and time are, or else its fingerprint: SHA-256 over its first and
last 4 KiB and its size. A last line without an end waits until the end comes. Bytes that
are no UTF-8 come as U+FFFD. An empty file has no lines and its end is byte 0.

Ranges of at most `split` bytes are read by tasks, files longer than that by several of
them, each taking the lines that begin in its range. A file that was replaced after its
batch was planned gives no lines; the next batch finds it rewritten.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "json_line_files"
SCHEMA = "path string, version long, change string, start long, raw string"
EDGE = 4096
BLOCK = 1 << 20
SPLIT = 64 << 20
READERS = 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def fingerprint(file, size: int) -> str:
    """Of the first `size` bytes of an open file: their ends and their number."""
    file.seek(0)
    ends = file.read(min(EDGE, size))
    file.seek(max(0, size - EDGE))
    return hashlib.sha256(ends + file.read(min(EDGE, size)) + str(size).encode()).hexdigest()


def complete_end(file, low: int, size: int) -> int:
    """The place after the last line end between `low` and `size`, or `low` if there is none."""
    at = size
    while at > low:
        start = max(low, at - BLOCK)
        file.seek(start)
        place = file.read(at - start).rfind(b"\n")
        if place >= 0:
            return start + place + 1
        at = start
    return low


@dataclass(frozen=True)
class Known:
    """What a manifest says of a file."""

    path: str
    size: int
    modified: int
    version: int
    upto: int
    print: str
    gone: bool = False


def listed(root: str, pattern: str) -> dict[str, tuple[int, int]]:
    """Size and time of the files below `root` whose names match; `root` may be one file."""
    system, base = opened(root)
    (own,) = system.get_file_info([base])
    found = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {f.path: (f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)}


def look(system: fs.FileSystem, path: str, size: int, modified: int, old: Known | None) -> Known | None:
    """The file's row in the next manifest; null if it went while it was looked at."""
    if old and (old.size, old.modified) == (size, modified):
        return old if not old.gone else Known(**asdict(old) | {"gone": False})
    try:
        with system.open_input_file(path) as file:
            now = fingerprint(file, size)
            if old and now == old.print:
                return Known(path, size, modified, old.version, old.upto, now)
            if old and size > old.size and fingerprint(file, old.size) == old.print:
                return Known(path, size, modified, old.version, complete_end(file, old.upto, size), now)
            return Known(path, size, modified, old.version + 1 if old else 1, complete_end(file, 0, size), now)
    except FileNotFoundError:
        return None


def survey(root: str, pattern: str, before: dict[str, Known]) -> dict[str, Known]:
    """The next manifest. Only files whose size or time changed are opened, for their ends."""
    system, _ = opened(root)
    sizes = listed(root, pattern)
    with ThreadPoolExecutor(READERS) as pool:
        seen = pool.map(lambda p: look(system, p, *sizes[p], before.get(p)), sizes)
        now = {k.path: k for k in seen if k}
    return now | {p: Known(**asdict(k) | {"gone": True}) for p, k in before.items() if p not in now}


@dataclass
class Ranges(InputPartition):
    """Work of one task: changes to tell, and (path, version, change, low, high, bytes known, their fingerprint) to read."""

    root: str
    told: list
    parts: list


def difference(root: str, before: dict[str, Known], now: dict[str, Known], split: int) -> list[Ranges]:
    """Tasks for what `now` has and `before` has not, each of about `split` bytes or less."""
    out = [Ranges(root, [], [])]
    room = split

    def put(into: str, item: tuple, cost: int) -> None:
        nonlocal room
        if cost > room:
            out.append(Ranges(root, [], []))
            room = split
        getattr(out[-1], into).append(item)
        room -= cost

    for path, k in sorted(now.items()):
        old = before.get(path)
        if old and k.gone != old.gone:
            put("told", (path, k.version, "tombstone" if k.gone else "restore"), 1 << 10)
        if k.gone and (old is None or old.version == k.version and old.upto == k.upto):
            continue
        anew = old is None or old.version != k.version
        change, low = ("new" if old is None else "rewrite", 0) if anew else ("append", old.upto)
        if not anew and low == k.upto:
            continue
        put("told", (path, k.version, change), 1 << 10)
        for at in range(low, k.upto, split):
            put("parts", (path, k.version, change, at, min(at + split, k.upto), k.size, k.print), min(split, k.upto - at))
    return out


def lines_of(file, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) of the lines that begin from `low` on and before `high`, blanks left out.

    A line that began before `low` belongs to another range.
    """
    at, held, skip = low, b"", False
    if low:
        file.seek(low - 1)
        skip = file.read(1) != b"\n"
    file.seek(low)
    while at < high:
        block = file.read(BLOCK)
        if not block:
            return
        pieces = block.split(b"\n")
        if len(pieces) == 1:
            held = [held, block] if isinstance(held, bytes) else [*held, block]
            continue
        pieces[0] = (held if isinstance(held, bytes) else b"".join(held)) + pieces[0]
        held = pieces.pop()
        for piece in pieces:
            if at >= high:
                return
            if not skip and piece.strip():
                yield at, piece
            skip = False
            at += len(piece) + 1


def rows_of(work: Ranges) -> Iterator[tuple]:
    for path, version, change in work.told:
        yield path, version, change, None, None
    system, _ = opened(work.root)
    for path, version, change, low, high, size, known in work.parts:
        try:
            with system.open_input_file(path) as file:
                if file.size() < size or fingerprint(file, size) != known:
                    continue
                for at, line in lines_of(file, low, high):
                    yield path, version, change, at, line.decode("utf-8", "replace")
        except FileNotFoundError:
            continue


class Manifests:
    """Generations of a manifest in a shared folder; the highest is the last."""

    def __init__(self, folder: str):
        self.system, self.folder = opened(folder)
        self.system.create_dir(self.folder, recursive=True)

    def _path(self, generation: int) -> str:
        return f"{self.folder}/{generation:012d}.jsonl"

    def generations(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(self.folder))
        return sorted(int(f.base_name[:12]) for f in found if fnmatch.fnmatch(f.base_name, "[0-9]*.jsonl"))

    def read(self, generation: int) -> dict[str, Known]:
        if not generation:
            return {}
        with self.system.open_input_stream(self._path(generation)) as file:
            rows = (Known(**json.loads(line)) for line in file.read().splitlines())
            return {k.path: k for k in rows}

    def write(self, generation: int, files: dict[str, Known]) -> None:
        """Whole or not at all: written beside, then renamed."""
        beside = f"{self.folder}/_{generation:012d}"
        with self.system.open_output_stream(beside) as file:
            for k in files.values():
                file.write(json.dumps(asdict(k)).encode() + b"\n")
        self.system.move(beside, self._path(generation))

    def drop_before(self, generation: int) -> None:
        for g in self.generations():
            if g < generation:
                self.system.delete_file(self._path(g))


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.root, self.pattern, self.split = _common(options)

    def partitions(self):
        return difference(self.root, {}, survey(self.root, self.pattern, {}), self.split)

    def read(self, partition):
        return rows_of(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.pattern, self.split = _common(options)
        self.folder = options["manifests"]

    def initialOffset(self):  # noqa: N802
        return {"generation": 0}

    def latestOffset(self):  # noqa: N802
        kept = Manifests(self.folder)
        last = max(kept.generations(), default=0)
        before = kept.read(last)
        now = survey(self.root, self.pattern, before)
        if now != before:
            last += 1
            kept.write(last, now)
        return {"generation": last}

    def partitions(self, start, end):
        kept = Manifests(self.folder)
        return difference(self.root, kept.read(start["generation"]), kept.read(end["generation"]), self.split)

    def read(self, partition):
        return rows_of(partition)

    def commit(self, end):
        Manifests(self.folder).drop_before(end["generation"])


def _common(options) -> tuple[str, str, int]:
    return options["path"], options.get("pattern", "*.jsonl"), int(options.get("split", SPLIT))


class JsonLineFiles(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options)


def lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The complete lines of all files below `path`, and a row "new" of each file."""
    spark.dataSource.register(JsonLineFiles)
    return spark.read.format(NAME).options(path=path, **options).load()


def changes(spark: SparkSession, path: str, manifests: str, **options) -> DataFrame:
    """A stream of what changes below `path`; `manifests` is a shared folder of this stream alone."""
    spark.dataSource.register(JsonLineFiles)
    return spark.readStream.format(NAME).options(path=path, manifests=manifests, **options).load()


def live_lines(log: DataFrame) -> DataFrame:
    """path, version, start and raw of the lines that count in a log of changes with a column `batch`.

    Those of each file's highest version, unless the last that was told of the file is its
    tombstone. A range read twice counts once. Versions are grouped maxima, met by path
    and version, so only repeated lines of one place gather.
    """
    told = log.filter("start is null")
    order = F.struct("batch", F.col("version"), F.when(F.col("change") == "tombstone", 2).otherwise(1))
    last = told.groupBy("path").agg(F.max("version").alias("version"), F.max_by("change", order).alias("last"))
    kept = log.filter("start is not null").join(last.filter("last != 'tombstone'").drop("last"), ["path", "version"])
    return kept.groupBy("path", "version", "start").agg(F.any_value("raw").alias("raw"))


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """`lines` with record (by `schema`) and bad; `raw` is kept of bad lines only, for a side table."""
    valid = F.try_parse_json(F.col("raw")).isNotNull() & F.startswith(F.trim(F.col("raw")), F.lit("{"))
    read = lines.withColumn("record", F.from_json("raw", schema, {"mode": "PERMISSIVE"})).withColumn("bad", ~valid)
    return read.withColumn("raw", F.when(F.col("bad"), F.col("raw")))
