import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import jsonl, transcripts


class Collector:
    """Runs the stream over a folder, batch by batch, into a Parquet log."""

    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options = spark, base, options
        self.files = base / "in"
        self.files.mkdir()

    def step(self):
        """(file, change) of what is told, and (file, start, raw) of the lines, since the last call."""
        before = self.log().count()
        stream = jsonl.changes(self.spark, str(self.files), str(self.base / "manifests"), **self.options)
        out = str(self.base / "log")
        write = lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(self.base / "cp")).trigger(availableNow=True).start().awaitTermination()
        if self.log().count() == before:
            return [], []
        last = self.log().agg(F.max("batch")).first()[0]
        rows = self.log().filter(F.col("batch") == last).collect()
        name = lambda r: os.path.basename(r["path"])
        return sorted((name(r), r["change"]) for r in rows if r["start"] is None), sorted((name(r), r["start"], r["raw"]) for r in rows if r["start"] is not None)

    def log(self):
        if not (self.base / "log").exists():
            return self.spark.createDataFrame([], jsonl.SCHEMA + ", batch int")
        return self.spark.read.schema(jsonl.SCHEMA + ", batch int").parquet(str(self.base / "log"))

    def live(self):
        return sorted((os.path.basename(r["path"]), r["raw"]) for r in jsonl.live_lines(self.log()).collect())


def test_changes_of_files(spark, tmp_path):
    c = Collector(spark, tmp_path)
    a, b = c.files / "a.jsonl", c.files / "b.jsonl"
    a.write_text("1\n2\nhalf")
    b.write_text("x\n\n  \ny\n")
    (c.files / "other.txt").write_text("no\n")
    assert c.step() == ([("a.jsonl", "new"), ("b.jsonl", "new")], [("a.jsonl", 0, "1"), ("a.jsonl", 2, "2"), ("b.jsonl", 0, "x"), ("b.jsonl", 6, "y")])
    assert c.step() == ([], [])
    with a.open("a") as f:
        f.write(" and rest\n3\n")
    assert c.step() == ([("a.jsonl", "append")], [("a.jsonl", 4, "half and rest"), ("a.jsonl", 18, "3")])
    a.write_text("an entirely other text, longer than before\n")
    kept, when = b.read_bytes(), b.stat()
    b.unlink()
    assert c.step() == ([("a.jsonl", "rewrite"), ("b.jsonl", "tombstone")], [("a.jsonl", 0, "an entirely other text, longer than before")])
    assert c.live() == [("a.jsonl", "an entirely other text, longer than before")]
    b.write_bytes(kept)
    os.utime(b, ns=(when.st_atime_ns, when.st_mtime_ns))
    assert c.step() == ([("b.jsonl", "restore")], [])
    assert c.live() == [("a.jsonl", "an entirely other text, longer than before"), ("b.jsonl", "x"), ("b.jsonl", "y")]
    b.write_text("z\n")
    a.unlink()
    assert c.step()[0] == [("a.jsonl", "tombstone"), ("b.jsonl", "rewrite")]
    a.write_text("back, but another\n")
    assert c.step() == ([("a.jsonl", "restore"), ("a.jsonl", "rewrite")], [("a.jsonl", 0, "back, but another")])
    assert c.live() == [("a.jsonl", "back, but another"), ("b.jsonl", "z")]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_splits_lose_and_repeat_nothing(split, tmp_path, monkeypatch):
    monkeypatch.setattr(jsonl, "BLOCK", 5)
    rng = random.Random(split)
    data = b"".join(bytes(rng.choice(b"ab\xc3\xa9 ") for _ in range(rng.choice([0, 1, 3, 40]))) + b"\n" for _ in range(60)) + b"no end"
    (tmp_path / "f.jsonl").write_bytes(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    tasks = jsonl.difference(str(tmp_path), {}, jsonl.survey(str(tmp_path), "*.jsonl", {}), split)
    got = [(r[3], r[4]) for t in tasks for r in jsonl.rows_of(t) if r[3] is not None]
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        if line.strip():
            want.append((at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    assert sorted(got) == want and len(got) == len(want)
    if split == 7:
        assert max(sum(p[4] - p[3] for p in t.parts) for t in tasks) <= 7


def test_replaced_after_planning_gives_no_lines(tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text("1\n2\n")
    tasks = jsonl.difference(str(tmp_path), {}, jsonl.survey(str(tmp_path), "*.jsonl", {}), 64)
    path.write_text("9\n8\n7\n")
    assert [r for t in tasks for r in jsonl.rows_of(t) if r[3] is not None] == []
    path.unlink()
    assert [r for t in tasks for r in jsonl.rows_of(t) if r[3] is not None] == []


def test_a_manifest_without_a_logged_offset_is_not_lost(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.jsonl").write_text("1\n")
    options = {"path": str(tmp_path / "in"), "manifests": str(tmp_path / "m")}
    assert jsonl._Stream(options).latestOffset() == {"generation": 1}
    (tmp_path / "in" / "f.jsonl").write_text("1\n2\n")
    again = jsonl._Stream(options)
    end = again.latestOffset()
    rows = [r for t in again.partitions({"generation": 0}, end) for r in again.read(t)]
    assert [r[3:] for r in rows if r[3] is not None] == [(0, "1"), (2, "2")]
    again.commit(end)
    assert jsonl.Manifests(options["manifests"]).generations() == [end["generation"]]


def test_batch_of_transcripts(spark, tmp_path):
    rows = [json.dumps({"type": "user", "message": {"content": f"m{k}"}}) for k in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n[1]\nbad\n")
    (tmp_path / "b.jsonl").write_text("bad\nworse\n" + rows[0] + "\n")
    lines = transcripts.json_lines(spark, str(tmp_path), transcripts.FORMAT_A, split=1000)
    status = {os.path.basename(r["path"]): tuple(r)[1:] for r in transcripts.file_status(lines).collect()}
    assert status == {"a.jsonl": (202, 2, "ok"), "b.jsonl": (3, 2, "error")}
    got = transcripts.items_a(lines).filter(F.endswith("path", F.lit("a.jsonl"))).orderBy("line").collect()
    assert [r["text"] for r in got] == [f"m{k}" for k in range(200)]
    assert lines.rdd.getNumPartitions() > 5
