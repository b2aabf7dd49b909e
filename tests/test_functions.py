import sqlite3

from pyspark.sql import functions as F

from lodestone.functions import commands, privacy
from lodestone.operators import passages, ranking
from lodestone.sources import sqlite


def test_spans():
    text = "mail ann@example.com card 4111 1111 1111 1111 or 4111111111111112, password=hunter22 at 555-12-3456"
    assert [(text[a:b], c) for a, b, c in privacy.spans(text)] == [("ann@example.com", "email"), ("4111 1111 1111 1111", "card"), ("password=hunter22", "credential"), ("555-12-3456", "government_id")]
    assert privacy.scrub("a@b.co x") == "[REDACTED:email] x"
    assert privacy.scrub_structure({"Token": "x", "n": ["a@b.co", 1]}) == {"Token": "[REDACTED:credential]", "n": ["[REDACTED:email]", 1]}


def test_hashes(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [2]}', "x"), ('{"a":[2],"b":1}', "x"), (None, None)], "j string, v string")
    got = df.select(privacy.content_hash(F.col("j")), privacy.blind_index(F.col("v"), b"k"), privacy.scrubbed(F.col("v"))).collect()
    assert got[0][0] == got[1][0] and got[2][0] is None and got[0][1] == got[1][1] and len(got[0][1]) == 64
    assert privacy.receipt_summary(spark.createDataFrame([("a@b.co c@d.co",), ("x",)], "t string"), "t").collect()[0][1:] == (2, 1)


def test_scrubbed_json(spark):
    rows = ['{"b": "a@b.co", "token": "x"}', "no json, a@b.co", '{"cut": "a@b.co', "", None, "[" * 100_000 + "a@b.co"]
    df = spark.createDataFrame([(r,) for r in rows], "j string")
    got = [r[0] for r in df.select(privacy.scrubbed_json(F.col("j"))).collect()]
    assert got[:5] == ['{"b":"[REDACTED:email]","token":"[REDACTED:credential]"}', "no json, [REDACTED:email]", '{"cut": "[REDACTED:email]', "", None]
    assert got[5].endswith("[REDACTED:email]")


def test_commands():
    assert commands.segments("cd x && pytest -q | tee 'a b'") == [["cd", "x"], ["pytest", "-q"], ["tee", "a b"]]
    assert commands.verification_kind("cd x; python -m pytest tests") == "test" and commands.verification_kind("echo 'open") is None


def test_status_records_end_with_nul(spark):
    output = "# branch.oid 1\0001 .M N... 1 1 1 a b some\nodd file.py\0? new one\0002 R. N... 1 1 1 a b R100 to here\000from\tthere\0u UU N... 1 2 3 4 a b c both.py\0! out\0001 cut short\0"
    (got,) = spark.createDataFrame([(output,)], "o string").select(commands.status_of(F.col("o"))).first()
    assert [tuple(r) for r in got] == [
        ("ordinary", ".M", "some\nodd file.py", None), ("untracked", "?", "new one", None), ("rename_or_copy", "R.", "to here", "from\tthere"),
        ("unmerged", "UU", "both.py", None), ("ignored", "!", "out", None),
    ]
    rows = spark.createDataFrame([(None,), ("",), ("2 R. N... 1 1 1 a b R100 to",)], "o string").select(commands.status_of(F.col("o")).alias("s")).collect()
    assert [len(r["s"]) for r in rows] == [0, 0, 1] and rows[2]["s"][0]["original"] is None


def test_tokens_and_windows():
    text = " é one  two " + "x" * 100 + " end \n"
    ends = passages.token_ends(text)
    assert ends[-1] == len(text) and all(len(text[a:b].encode()) <= 64 for a, b in zip([0, *ends], ends, strict=False))
    assert list(passages.windows(10, 4, 1)) == [(0, 4), (3, 7), (6, 10)] and list(passages.windows(4, 4, 1)) == [(0, 4)] and not list(passages.windows(0))
    parts = list(passages.chunk_text("日本 " * 50 + "a" * 90, 60, 20))
    assert "".join(parts) == "日本 " * 50 + "a" * 90 and max(len(p.encode()) for p in parts) <= 60


def test_cover_density(spark):
    df = spark.createDataFrame([("a x b",), ("a b a",), ("x",), ("b b a",)], "t string")
    got = [r[0] for r in df.select(F.round(ranking.cover_density(F.col("t"), ["a", "b"]), 6)).collect()]
    assert got == [round(v / (v + 1), 6) for v in (1 / 3, 1.0, 0.0, 1 / 2)]


def test_sqlite(spark, tmp_path):
    path = tmp_path / "h.db"
    db = sqlite3.connect(path)
    db.execute("create table urls (id integer, url text)")
    db.executemany("insert into urls values (?, ?)", [(1, "a"), (2, None)])
    db.commit()
    db.close()
    got = sqlite.read_sqlite(spark, str(tmp_path), "select id, url from urls order by id", "id long, url string").collect()
    assert [(r["id"], r["url"]) for r in got] == [(1, "a"), (2, None)]
