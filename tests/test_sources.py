import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ingest
from lodestone.plans import sqlsurface
from lodestone.sources import files, paged, sinks, transcripts
from lodestone.streaming import ingest as streaming


def test_json_lines_and_items(spark, tmp_path):
    rows = [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": "hello"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:01Z", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "thinking", "text": "no"}, {"type": "tool_use", "name": "run", "input": {"a": 1}}]}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n" + '{"type": "user", "mess')
    lines = transcripts.json_lines(spark, str(tmp_path / "a.jsonl"), transcripts.FORMAT_A).cache()
    assert [tuple(r)[1:] for r in transcripts.file_status(lines).collect()] == [(3, 1, "ok")]
    assert [(r["surface"], r["text"]) for r in transcripts.items_a(lines).orderBy("line", "block").collect()] == [("user", "hello"), ("assistant", "hi"), ("tool_input", 'run {"a":1}')]


def test_items_b(spark, tmp_path):
    rows = [
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"cwd": "/x"}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}},
        {"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": {"type": "function_call_output", "output": "done"}},
    ]
    (tmp_path / "b.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    lines = transcripts.json_lines(spark, str(tmp_path / "b.jsonl"), transcripts.FORMAT_B)
    assert [(r["surface"], r["text"]) for r in transcripts.items_b(lines).orderBy("line").collect()] == [("user", "q"), ("tool_output", "done")]


def test_manifest_changes(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2"), ("c", "3")):
        (tmp_path / f"{name}.jsonl").write_text(text)
    before = spark.createDataFrame(transcripts.discover(spark, str(tmp_path)).collect())
    (tmp_path / "a.jsonl").write_text("1 more")
    (tmp_path / "b.jsonl").unlink()
    (tmp_path / "d.jsonl").write_text("4")
    got = {r["path"].rpartition("/")[2]: r["change"] for r in transcripts.changes(before, transcripts.discover(spark, str(tmp_path))).collect()}
    assert got == {"a.jsonl": "grown", "b.jsonl": "gone", "c.jsonl": "unchanged", "d.jsonl": "new"}


def test_export_and_chat(spark):
    node = lambda i, p, r, t: {"id": i, "parent": p, "message": {"id": "m" + i, "author": {"role": r}, "create_time": 10.0, "content": {"content_type": "text", "parts": [t]}}}
    export = [{"id": "c1", "title": "t", "mapping": {"1": node("1", None, "user", "a"), "2": node("2", "1", "assistant", "b")}}]
    got = transcripts.export_messages(spark.createDataFrame([(json.dumps(export),)], "value string")).orderBy("message").collect()
    assert [(r["message"], r["parent"], r["role"], r["text"]) for r in got] == [("m1", None, "user", "a"), ("m2", "m1", "assistant", "b")]
    lines = ["01/02/2024, 10:00 - Ann: hi", "more", "01/02/2024, 10:01 - Bob: yes"]
    chat = transcripts.chat_export(spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "f string, k int, t string"), "f", "k", "t")
    assert [(r["author"], r["text"]) for r in chat.orderBy("n").collect()] == [("Ann", "hi\nmore"), ("Bob", "yes")]


def test_visits(spark):
    visits = spark.createDataFrame([(1, 11644473600 * 1_000_000)], "url_id long, visit_time long")
    urls = spark.createDataFrame([(1, "u", "t")], "id long, url string, title string")
    assert transcripts.browser_visits(visits, urls, "webkit").select(F.unix_micros("visited_at")).first()[0] == 0


def test_files(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(b"Subject: S\nFrom: a@x\nMessage-ID: <1>\n\nbody text\n")
    (tmp_path / "c.ics").write_bytes(b"BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:9\r\nSUMMARY:Long\r\n er\r\nDTSTART:20240101T000000Z\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    (tmp_path / "p.vcf").write_bytes(b"BEGIN:VCARD\nFN:Ann\nEMAIL;TYPE=home:a@x\nEND:VCARD\n")
    (tmp_path / "f.rss").write_bytes(b"<rss><channel><item><guid>g</guid><title>T</title><description>&lt;b&gt;x&lt;/b&gt;</description></item></channel></rss>")
    (tmp_path / "bad.rss").write_bytes(b"<rss")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/one.json", "{}")
        f.writestr("pic.png", "x")
    (tmp_path / "z.zip").write_bytes(z.getvalue())
    got = {(r["kind"], r["record"], r["title"], r["body"], r["who"]) for r in files.read_files(spark, str(tmp_path)).filter("error is null").collect()}
    assert got == {("mail", "<1>", "S", "body text", "a@x"), ("event", "9", "Longer", "", ""), ("contact", "a@x", "Ann", "", "a@x"), ("entry", "g", "T", "x", ""), ("member", "a/one.json", "one.json", "{}", "")}
    assert files.read_files(spark, str(tmp_path)).filter("error is not null").count() == 1


def test_paged_source(spark):
    def fetch(cursor, limit):
        at = int(cursor or 0)
        return [{"id": k} for k in range(at, min(at + 3, 8))], str(at + 3) if at + 3 < 8 else None

    paged.register(spark, "numbers", fetch)
    assert sorted(int(r["id"]) for r in spark.read.format("numbers").load().collect()) == list(range(8))
    with pytest.raises(ValueError):
        list(paged.pages(lambda c, n: ([], "same")))


def events(spark, rows):
    return spark.createDataFrame(rows, "source string, native_id string, content string, arrival long, occurred_at timestamp, is_tombstone boolean, parent string")


def test_ingest_is_idempotent(spark, tmp_path):
    rows = [("s", "a", "1", 1, None, False, None), ("s", "a", "2", 2, None, False, None), ("s", "a", "1", 3, None, False, None), ("s", "b", "1", 4, None, False, "a"), ("s", "c", "1", 5, None, False, "b")]
    path = str(tmp_path / "log")
    streaming.write_batch(events(spark, rows), 0, path)
    streaming.write_batch(events(spark, rows + [("s", "a", "gone", 6, None, True, None), ("s", "d", "1", 7, None, False, None)]), 1, path)
    once = sorted(map(tuple, streaming.read_log(spark, path).select("native_id", "content", "revision", "batch").collect()))
    streaming.write_batch(events(spark, rows + [("s", "a", "gone", 6, None, True, None), ("s", "d", "1", 7, None, False, None)]), 1, path)
    assert once == sorted(map(tuple, streaming.read_log(spark, path).select("native_id", "content", "revision", "batch").collect()))
    assert once == [("a", "1", 1, 0), ("a", "2", 2, 0), ("a", "gone", 3, 1), ("b", "1", 1, 0), ("c", "1", 1, 0), ("d", "1", 1, 1)]
    assert [r["native_id"] for r in ingest.live(streaming.read_log(spark, path)).collect()] == ["d"]
    forgotten = spark.createDataFrame([("s", "e")], "source string, native_id string")
    streaming.write_batch(events(spark, [("s", "e", "x", 9, None, False, None)]), 2, path, forgotten)
    assert streaming.read_log(spark, path).count() == 6


def test_stream_into_log(spark, tmp_path):
    source = tmp_path / "in"
    events(spark, [("s", "a", "1", 1, None, False, None)]).write.parquet(str(source))
    stream = spark.readStream.schema(events(spark, []).schema).parquet(str(source))
    streaming.start(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    events(spark, [("s", "a", "1", 2, None, False, None), ("s", "a", "2", 3, None, False, None)]).write.mode("append").parquet(str(source))
    streaming.start(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["content"], r["revision"]) for r in streaming.read_log(spark, str(tmp_path / "log")).collect()) == [("1", 1), ("2", 2)]


def test_month_datasets(spark, tmp_path):
    df = spark.sql("select * from values (1, date'2024-01-30', date'2024-02-02'), (2, date'2024-03-01', date'2024-03-01') as t(id, a, b)")
    rows = sinks.month_rows(df, "a", "b")
    path = str(tmp_path / "m")
    sinks.write_partitions(rows, path, ["bucket"])
    stored = sinks.digests(rows, ["bucket"])
    more = sinks.month_rows(df.union(spark.sql("select 3, date'2024-03-05', date'2024-03-05'")), "a", "b")
    changed = sinks.changed_only(more, ["bucket"], stored)
    assert {str(r["bucket"]) for r in changed.select("bucket").distinct().collect()} == {"2024-03-01"}
    sinks.write_partitions(changed, path, ["bucket"])
    assert spark.read.parquet(path).count() == 4


def test_sql_surface(spark):
    views = {"docs": spark.range(5).withColumnRenamed("id", "n")}
    assert sqlsurface.run_program(spark, "WITH x AS (SELECT n FROM docs WHERE n > 1) SELECT count(*) AS c FROM x JOIN docs USING (n)", views).first()["c"] == 3
    for bad in ("DROP TABLE docs", "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM other", "CREATE VIEW v AS SELECT 1", "INSERT INTO docs SELECT 1"):
        with pytest.raises(ValueError):
            sqlsurface.run_program(spark, bad, views)
    many = {"docs": spark.range(10_050).withColumnRenamed("id", "n")}
    for program, n, complete in (("SELECT n FROM docs", 10_000, False), ("SELECT n FROM docs WHERE n < 10000", 10_000, True), ("SELECT n FROM docs WHERE n < 0", 0, None)):
        rows = sqlsurface.run_program(spark, program, many).collect()
        assert len(rows) == n and {r["complete"] for r in rows} == ({complete} if n else set())
    assert [t.name for t in spark.catalog.listTables() if t.name == "docs"] == []
    with pytest.raises(ValueError):
        sqlsurface.run_program(spark, "SELECT n AS complete FROM docs", many)
