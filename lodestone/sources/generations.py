"""Partitioned Parquet datasets that change as a whole: staged builds, and manifests that are committed one at a time.

A dataset is a folder with `data/build=<id>/<partition>` and `manifests/<generation>`. A
manifest lists the partitions that are live, each with its build, rows, digest and the
generation that brought it. A build is written beside the live data and seen by nobody.
Its commit creates the manifest of the next generation, which fails if that exists: then
another writer was first, and the commit looks again. It is told "stale", and its files go,
if a partition it rebuilt has changed since the generation it started from; if the other
writer changed other partitions only, it goes on from there. Partitions that were rebuilt
and have no rows vanish. Readers take the newest manifest, or the one they name, so a
reader never sees half a commit, and files are removed only by `vacuum`.

Manifests are put in place by a rename that does not overwrite, which HDFS does atomically;
a store without it needs a committer of its own. A manifest holds a row a partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_FILE = 1_000_000


@dataclass(frozen=True)
class Build:
    """A staged build: where it is, what it has, which partitions it stands for, and the generation it started from."""

    id: str
    base: int
    parts: dict[str, dict]
    rebuilt: frozenset[str] | None


class Dataset:
    """A dataset at `path`, partitioned by `keys`; `schema` (DDL, with the keys) is what readers of an empty one see."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), keys, schema
        self._fs_package = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, below: str):
        return self._fs_package.Path(f"{self.path}/{below}" if below else self.path)

    def _names(self, below: str) -> list[str]:
        at = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def generation(self) -> int:
        """The newest generation, 0 before the first commit."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")), default=0)

    def manifest(self, generation: int | None = None) -> dict[str, dict]:
        """Live partitions by their path below a build."""
        generation = self.generation() if generation is None else generation
        if not generation:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/{generation:012d}.json", wholetext=True).first()[0]
        return json.loads(text)["partitions"]

    def _folders(self, below: str, depth: int) -> Iterable[str]:
        for name in self._names(below):
            if "=" in name:
                yield from self._folders(f"{below}/{name}", depth - 1) if depth > 1 else [f"{below}/{name}"]

    def name_of(self, **values) -> str:
        """A partition's path from its plain values."""
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{k}={escape(str(values[k]))}" for k in self.keys)

    def stage(self, rows: DataFrame, rebuilt: Iterable[str] | None = None, base: int | None = None) -> Build:
        """Writes `rows` as a build that nobody sees. `rebuilt` names the partitions it stands for, by `name_of`:
        those without rows vanish; None: all that the dataset has and those of `rows`. `base` is the generation
        that `rows` were made from, the newest by default; name it if they were read earlier."""
        base = self.generation() if base is None else base
        build = uuid.uuid4().hex
        target = f"{self.path}/data/build={build}"
        spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c not in self.keys]), F.lit(8))
        rows.repartition(*self.keys, spread).write.partitionBy(*self.keys).option("maxRecordsPerFile", ROWS_A_FILE).option("compression", "zstd").parquet(target)
        places = [f.removeprefix(f"data/build={build}/") for f in self._folders(f"data/build={build}", len(self.keys))]
        told = {}
        if places:
            written = self.spark.read.schema(self.schema).parquet(target)
            row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(written.columns) if c not in self.keys]).cast("decimal(38,0)")
            folder = F.regexp_extract(F.col("_metadata.file_path"), f"build={build}/(.*)/[^/]*$", 1)
            told = {r["f"]: r for r in written.groupBy(folder.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("d")).collect()}
        unquote = {self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p).toUri().getRawPath(): p for p in places}
        by_place = {unquote.get(f, f): r for f, r in told.items()}
        parts = {p: {"build": build, "rows": by_place[p]["n"], "digest": by_place[p]["d"]} for p in places}
        return Build(build, base, parts, None if rebuilt is None else frozenset(rebuilt) | frozenset(places))

    def commit(self, build: Build) -> str:
        """"committed", "unchanged" (equal rows: nothing to do) or "stale"; but for the first, the build's files go."""
        base = self.manifest(build.base)
        while True:
            generation = self.generation()
            live = self.manifest(generation)
            rebuilt = frozenset(base) | frozenset(live) | frozenset(build.parts) if build.rebuilt is None else build.rebuilt
            moved = [p for p in rebuilt if (live.get(p) or {}).get("generation") != (base.get(p) or {}).get("generation")]
            if moved:
                self.discard(build)
                return "stale"
            same = lambda p: p in live and all(live[p][k] == build.parts[p][k] for k in ("rows", "digest"))
            new = {p: live[p] if same(p) else {**build.parts[p], "generation": generation + 1} for p in build.parts}
            after = {p: v for p, v in live.items() if p not in rebuilt} | new
            if after == live:
                self.discard(build)
                return "unchanged"
            if self._create(generation + 1, after):
                return "committed"

    def _create(self, generation: int, partitions: dict[str, dict]) -> bool:
        """Whether this writer made the manifest of `generation`."""
        staged, target = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{generation:012d}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps({"generation": generation, "partitions": partitions}, sort_keys=True).encode()))
        out.close()
        jvm = self.spark.sparkContext._gateway.jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._fs_package.FileContext.getFileContext(staged.toUri(), self._conf).rename(staged, target, how)
            return True
        except Exception as e:  # the manifest is there: another writer was first
            self._fs.delete(staged, False)
            if self._fs.exists(target):
                return False
            raise e

    def discard(self, build: Build) -> None:
        self._fs.delete(self._path(f"data/build={build.id}"), True)

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the newest by default."""
        live = self.manifest(generation)
        if not live:
            return self.spark.createDataFrame([], self.schema)
        names = self.spark.createDataFrame([], self.schema).columns
        paths = [f"{self.path}/data/build={v['build']}/{p}" for p, v in sorted(live.items())]
        return self.spark.read.schema(f"{self.schema}, build string").option("basePath", f"{self.path}/data").parquet(*paths).select(*names)

    def vacuum(self, keep: int = 2) -> int:
        """Removes builds that none of the last `keep` generations has, and older manifests; builds that are being
        staged must be committed or given up before. How many builds went."""
        newest = self.generation()
        named = {v["build"] for g in range(max(1, newest - keep + 1), newest + 1) for v in self.manifest(g).values()}
        gone = [n for n in self._names("data") if n.removeprefix("build=") not in named]
        for n in gone:
            self._fs.delete(self._path(f"data/{n}"), True)
        for n in self._names("manifests"):
            if n.endswith(".json") and int(n.removesuffix(".json")) <= newest - keep:
                self._fs.delete(self._path(f"manifests/{n}"), False)
        return len(gone)
