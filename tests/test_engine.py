"""Operators without SQL of their own, against brute force."""

import random
import time
import tracemalloc
import types

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators import audits, contextual, graphs, ingest, queues, tools, vectors
from lodestone.plans import evidence, relational

SF = "/root/testdata/sf0.001"


def test_approximate_recall(spark):
    """Every fiftieth id is asked; recall of the ten nearest others, against all distances."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in evidence.QUERIES["top11_approximate"][0](spark, SF).collect():
        got.setdefault(r["query"], {})[r["vec_id"]] = r["distance"]
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    recall = []
    for q, found in got.items():
        exact = 1 - x @ x[ids == q][0]
        best = ids[np.lexsort((ids, exact.round(6)))][:10].tolist()
        assert len(found) == 10 and all(abs(exact[ids == i][0] - d) < 2e-6 for i, d in found.items())
        recall.append(len((set(best) & set(found)) - {q}) / 9)
    assert np.mean(recall) >= 0.9


def test_bins(spark):
    """Snake order over many ranges, one group far larger than the others."""
    rng = random.Random(1)
    rows = [("big" if k % 3 else rng.choice("ab"), k, rng.randrange(1, 60)) for k in range(3000)] + [(None, 3001, 5), (None, 3002, 9)]
    df = spark.createDataFrame(rows, "g string, k long, s long").repartition(7)
    out = queues.lightest_bins(df, "g", "k", "s", 8)
    assert "Pandas" not in out._jdf.queryExecution().toString()
    want = set()
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))):
            want.add((*r, n % 16 if n % 16 < 8 else 15 - n % 16))
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(rows)
    totals = out.filter("g = 'big'").groupBy("bin").agg(F.sum("s")).collect()
    assert max(t[1] for t in totals) - min(t[1] for t in totals) <= 60


def test_segments(spark):
    """Greedy cuts at whole characters, against bytes cut by hand."""
    texts = ["", "abc", "é日本語🙂" * 40, "a" * 101, "x🙂" * 33]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tools.segments(F.col("t"), 10)).collect()]
    for text, parts in zip(texts, got, strict=True):
        want, data, at = [], text.encode(), 0
        while at < len(data) or not want:
            end = min(at + 10, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
            want.append(data[at:end].decode())
            at = end
        assert parts == want


def test_segments_of_long_texts(spark):
    """Work in proportion to the text: a fold over its segments that takes all its bytes at each step would need minutes."""
    texts = ["a\n" * 1_500_000, "é日本語🙂\r" * 200_000]
    began = time.monotonic()
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tools.segments(F.col("t"), 500)).collect()]
    assert time.monotonic() - began < 60
    assert ["".join(parts) for parts in got] == texts
    sizes = [[len(p.encode()) for p in parts] for parts in got]
    assert set(sizes[0][:-1]) == {500} and all(496 < n <= 500 for n in sizes[1][:-1])
    assert spark.createDataFrame([(None,)], "t string").select(tools.segments(F.col("t"), 500)).first()[0] is None


def test_live_below_a_long_chain(spark):
    """A tombstone reaches 200 rows below it; a cycle ends."""
    rows = [("s", "k0", True, None)] + [("s", f"k{k}", False, f"k{k - 1}") for k in range(1, 201)]
    rows += [("s", "a", False, "b"), ("s", "b", False, "a"), ("t", "k5", False, "k4"), ("s", "c", False, "gone")]
    log = spark.createDataFrame([(*r, 1) for r in rows], "source string, native_id string, is_tombstone boolean, parent string, revision int")
    assert {(r["source"], r["native_id"]) for r in ingest.live(log).collect()} == {("s", "a"), ("s", "b"), ("t", "k5"), ("s", "c")}


def test_descendants_to_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(20, 5)], "parent int, child int")
    got = {r["node"]: r["depth"] for r in graphs.descendants(edges, spark.createDataFrame([(0,)], "root int")).collect()}
    assert got == {k: k for k in range(21)}


def test_inverted_file_asks_few_cells_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 32)) * 0.3
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 32)]
    table = spark.createDataFrame(rows, "k long, v array<double>")
    asked = table.filter("k % 50 = 0")
    cells, probes = vectors.train(table, "k", "v")
    placed = vectors.cells(table, "v", cells)
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(sizes.values()) == 6000
    met = sum(sizes[r["cell"]] for r in vectors.cells(asked, "v", cells, probes).collect())
    assert met < 0.2 * 6000 * 120  # distances, of those of the exact scan
    want, got = {}, {}
    for into, found in ((want, vectors.exact(asked, table, "k", "v", 10, block=500)), (got, vectors.search(asked, placed, "k", "v", 10, cells, probes, block=40))):
        for r in found.collect():
            into.setdefault(r["query"], {})[r["k"]] = r["distance"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in want.items():
        assert list(found) and set(found) == set(np.lexsort((np.arange(6000), (1 - unit @ unit[q]).round(6)))[:10].tolist())
    assert len(want) == 120 and np.mean([len(set(want[q]) & set(got.get(q, {}))) / 10 for q in want]) >= 0.9


def test_placing_rows_holds_few_products():
    """A batch of 10,000 rows and 4,096 cells is placed in slices; the whole matrix and its order would be 655 MB."""
    rng = np.random.default_rng(5)
    x, centres = rng.normal(size=(10_000, 8)), rng.normal(size=(4096, 8))
    tracemalloc.start()
    one, three = vectors.nearest_centres(x, centres), vectors.nearest_centres(x[:600], centres, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    order = np.argsort(-(x[:600] @ centres.T), axis=1, kind="stable")
    assert (three == order[:, :3]).all() and (one[:600, 0] == order[:, 0]).all()
    assert vectors.nearest_centres(x[:0], centres, 2).shape == (0, 2)
    sent = types.SimpleNamespace(value=centres)
    asked = pd.DataFrame({"k": range(30), "v": list(x[:30])})
    parts = list(vectors._nearest_cells(sent, "v", 1000)(iter([asked])))
    assert max(map(len, parts)) <= vectors.COPIES and sorted(pd.concat(parts)["k"].value_counts()) == [1000] * 30


def test_contained_items(spark):
    texts = ["The quick  brown fox jumps over the lazy dog again", "xab cd efy", "alpha beta", None, "", "Ünder a bridge", "one two three four five six seven eight"]
    said = ["quick brown fox jumps over the lazy", "ick brown fox jumps over the la", "ab cd ef", "ha be", "a", "", None, "lazy cat", "ünder", "two three four five six seven eight nine", "wo three fou", "bridge", "e q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    items = spark.createDataFrame(list(enumerate(said)), "i long, q string")
    norm = lambda s: " ".join(s.lower().split())
    want = {(d, i) for d, t in enumerate(texts) for i, q in enumerate(said) if t is not None and q is not None and norm(q) in norm(t)}
    got = [tuple(r) for r in audits.contained(docs, "d", "t", items, "i", "q").collect()]
    assert set(got) == want and len(got) == len(want)
    assert audits.contained(docs, "d", "t", items.limit(0), "i", "q").count() == 0


def test_visible_text(spark):
    cases = {
        '{"message":{"content":[{"type":"text","text":"hi"},{"type":"x"},{"content":[" ",{"text":"there"}]}]}}': "hi\nthere", '{"message":"hello"}': "hello", '"quoted"': "quoted", "plain {": "plain {",
        "[1,2]": None, "12": None, "12 apples": "12 apples", " ": None, '{"a":1}': None, '{"payload":{"message":"m","content":"c"},"text":"m"}': "m\nc", "null": None, "NaN": "NaN", "{broken": "{broken",
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", tools.visible_text(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == {**cases, None: None}


def test_merged_json_keeps_what_is_nested(spark):
    rows = [('{"a":{"b":1},"k":1}', '{"k":[true,null],"z":"y"}'), ('{"a":1}', None), (None, None), ("[1]", '{"a":"1"}')]
    got = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(tools.merged_json(F.col("x"), F.col("y"))).collect()]
    assert got == ['{"a":{"b":1},"k":[true,null],"z":"y"}', '{"a":1}', "{}", '{"a":"1"}']


def test_closure_by_doubling_against_search_by_hand(spark):
    rng = random.Random(7)
    graphs_ = {
        "chain with a shortcut": [(k, k + 1) for k in range(150)] + [(3, 100)],
        "cycle": [(k, (k + 1) % 37) for k in range(37)] + [(5, 5)],
        "many parents": [(rng.randrange(40), rng.randrange(40)) for _ in range(200)],
        "tree": [(k // 2, k) for k in range(1, 300)],
    }
    for name, given in graphs_.items():
        below = {}
        for a, b in given:
            below.setdefault(a, set()).add(b)
        for most in (None, 5):
            want = {}
            for root in (0, 3, 999):
                depth, at = {root: 0}, [root]
                while at and (most is None or depth[at[0]] < most):
                    new = [c for x in at for c in sorted(below.get(x, ())) if c not in depth]
                    for x in dict.fromkeys(new):
                        depth[x] = depth[at[0]] + 1
                    at = list(dict.fromkeys(new))
                want |= {(root, n): d for n, d in depth.items()}
            edges, roots = spark.createDataFrame(given, "parent int, child int"), spark.createDataFrame([(0,), (3,), (999,), (0,)], "root int")
            got = graphs.descendants(edges, roots, most).collect()
            assert {(r["root"], r["node"]): r["depth"] for r in got} == want and len(got) == len(want), name
    chain = graphs.strides(spark.createDataFrame([(k, k + 1) for k in range(150)], "parent int, child int"))
    assert [s.count() for s in chain] == [151 - (1 << k) for k in range(8)]
    assert graphs.descendants(spark.createDataFrame([], "parent int, child int"), roots).count() == 3


def test_passages_in_context(spark):
    parts = [(1, k, n, t) for k, (n, t) in enumerate([(5, "opening zero"), (900, "opening one " + "x" * 300), (3, "two é"), (4, "three"), (2, "four"), (9, "five")])] + [(2, 0, 1, "日" * 4000)]
    table = spark.createDataFrame(parts, "doc_id long, ordinal int, n_tokens int, text string")
    lines = contextual.metadata_lines({"source": F.lit(" mail "), "branch": F.lit(None), "blank": F.lit("  ")})
    out = {(r["doc_id"], r["ordinal"]): r for r in contextual.contextual(table, table.filter("doc_id = 1").select("doc_id").distinct().withColumn("lines", lines), most_tokens=30).collect()}
    got = out[1, 3]["context_text"].split("\n")
    # the second opening passage does not fit; the nearer ones after it do
    assert got == ["[document context]", "source: mail", "[support passage 0]", "opening zero", "[support passage 2]", "two é", "[support passage 4]", "four", "[support passage 5]", "five", "[target passage 3]", "three"]
    assert out[1, 3]["n_support"] == 4 and out[1, 1]["n_support"] == 0
    alone = out[2, 0]["context_text"]
    assert len(alone.encode()) <= contextual.MOST_BYTES and alone.count("日") > 2000 and contextual.LEFT_OUT in alone and "�" not in alone
    tight = contextual.contextual(table, table.select("doc_id").limit(0).withColumn("lines", lines), most_bytes=560).collect()
    assert all(len(r["context_text"].encode()) <= 560 for r in tight if r["doc_id"] == 1)


def test_set_difference_groups_once(spark):
    """Both ways, repeated and null keys, against sets; no join, so no sort of either side."""
    left, right = [1, 1, 2, 3, 3, None], [2, 2, 5, 5, 6, None, None]
    got = relational.set_difference(*[spark.createDataFrame([(k,) for k in side], "k long") for side in (left, right)])
    assert {tuple(r) for r in got.collect()} == {("orders only", 5, 8), ("lines only", 3, 11)}
    assert "Join" not in got._jdf.queryExecution().toString()
    assert relational.set_difference(*[spark.createDataFrame([(4,)], "k long")] * 2).count() == 0
