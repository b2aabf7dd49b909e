"""Packing by size and caller programs over shards."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import programs as P


def packed(spark, sizes, n):
    table = spark.createDataFrame(list(enumerate(sizes)), "k long, s long")
    rows = P.pack(table, "k", "s", n).collect()
    assert sorted((r["k"], r["s"]) for r in rows) == [(k, max(s or 0, 0)) for k, s in enumerate(sizes)]
    loads = [0] * n
    for r in rows:
        loads[r["shard"]] += r["s"]
    return loads


def test_shards_are_balanced(spark):
    rng = random.Random(3)
    sizes = [int(rng.paretovariate(1.3) * 100) for _ in range(3000)] + [0, None]
    total = sum(s or 0 for s in sizes)
    for n in (1, 4, 7):
        loads = packed(spark, sizes, n)
        assert sum(loads) == total and max(loads) <= max(1.1 * total / n, max(s or 0 for s in sizes))
    loads = packed(spark, [10_000] + [10] * 1000, 4)  # one document is half of all
    assert max(loads) == 10_000 and max(sorted(loads)[:3]) <= 1.1 * 5000
    assert packed(spark, [5, 5, 5], 8).count(5) == 3
    assert packed(spark, [], 3) == [0, 0, 0] and packed(spark, [0, 0], 2) == [0, 0]


@pytest.fixture
def count_words():
    def count(docs):  # a local function, so that workers need not import the tests
        for d in docs:
            for w in d.text.split():
                if w == "boom":
                    raise ValueError("boom")
                if w == "steal":
                    yield "not-mine", "x"
            yield d.receipt, len(d.text.split())

    return count


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, " ".join(["w"] * (k % 9)) if k else None) for k in range(200)], "k long, t string")


def test_program_over_shards(spark, docs, count_words):
    out = P.run_program(docs, "k", "t", count_words, 5)
    receipts = {r[0]: r[1] for r in docs.select(F.sha2(F.concat_ws("\0", F.col("k").cast("string"), F.coalesce("t", F.lit(""))).cast("binary"), 256), "k").collect()}
    rows = {receipts[r["receipt"]]: int(r["value"]) for r in out.filter("kind = 'row'").collect()}
    assert rows == {k: k % 9 for k in range(200)}
    reports = out.filter("kind = 'report'").collect()
    assert sum(r["n_docs"] for r in reports) == 200 and all(r["complete"] for r in reports)
    assert sum(r["n_bytes"] for r in reports) == sum(max(0, 2 * (k % 9) - 1) for k in range(200))


def test_a_failing_shard_stands_alone(spark, docs, count_words):
    for word, reason in (("boom", "ValueError: boom"), ("steal", "PermissionError")):
        out = P.run_program(docs.withColumn("t", F.when(F.col("k") == 17, F.lit(f"w {word} w")).otherwise(F.col("t"))), "k", "t", count_words, 4)
        reports = {r["shard"]: r for r in out.filter("kind = 'report'").collect()}
        (failed,) = [r for r in reports.values() if not r["complete"]]
        assert failed["reason"].startswith(reason)
        rows = out.filter("kind = 'row'")
        assert rows.filter(F.col("shard") == failed["shard"]).count() == 0
        assert rows.count() == 200 - failed["n_docs"]


def test_chosen_documents(spark, docs, count_words):
    out = P.run_on(docs, "k", "t", [3, 5, 5], count_words)
    assert sorted(r["value"] for r in out.filter("kind = 'row'").collect()) == ["3", "5"]
    with pytest.raises(LookupError):
        P.run_on(docs, "k", "t", [3, 999], count_words)


def test_sizes_with_parts(spark):
    docs = spark.createDataFrame([(1, 10), (2, None), (3, 5)], "k long, s long")
    parts = spark.createDataFrame([(1, 4), (1, None), (2, 7), (9, 1)], "k long, s long")
    assert sorted(tuple(r) for r in P.document_sizes(docs, parts, "k", "s").collect()) == [(1, 14), (2, 7), (3, 5)]
