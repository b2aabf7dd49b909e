"""Periodic runs, token counts and source divergence against brute force, the library itself and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import divergence, periodic_runs, token_counts

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def runs_by_hand(w, least=12):
    """Every maximal stretch for every period; the least period of equal bounds."""
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        x = 0
        while x < n - p:
            y = x
            while y < n - p and w[y] == w[y + p]:
                y += 1
            if y > x and y + p - x >= max(least, 2 * p):
                out.setdefault((x, y + p), p)
            x = max(y, x + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed_by_hand(w, runs):
    gone = {x for s, n, p in runs for x in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def repetitive(rng):
    out = [None, "", " \n\t", "a", "a " * 40, "a b " * 30, "x y " * 13, "é日 é日\x1c " * 20]
    for _ in range(200):
        letters = "abcde"[: rng.choice([1, 2, 3, 5])]
        w = [rng.choice(letters) for _ in range(rng.randrange(0, 70))]
        if w and rng.random() < 0.6:
            w = w[:3] + w[: rng.randrange(1, len(w) + 1)] * rng.randrange(2, 6) + w[5:]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("batch", [1, 40, 1 << 18])
def test_runs_by_hand(spark, batch):
    texts = repetitive(random.Random(batch))
    texts += texts[:50]  # repeated rows
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, RUNS int, other string").coalesce(2)
    found = periodic_runs.periodic_runs(docs, batch=batch)
    assert found.columns == ["doc_id", "text", "other", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = WORD.findall(r["text"] or "")
        want = runs_by_hand(w)
        assert [tuple(x) for x in r["runs"]] == want
        assert r["collapsed"] == collapsed_by_hand(w, want)


def test_runs_of_a_long_text_and_slices_of_the_grid(monkeypatch):
    rng = random.Random(9)
    w = [rng.choice("abcdefgh") for _ in range(1500)]
    w[300:300] = w[100:160] * 4
    monkeypatch.setattr(periodic_runs, "PAIRS", 500)
    n, starts, lengths, periods, collapsed = periodic_runs._of_texts([" ".join(w)], 12)
    want = runs_by_hand(w)
    assert want and n[0] == len(want) and list(zip(starts, lengths, periods, strict=True)) == want
    assert collapsed == [collapsed_by_hand(w, want)]
    monkeypatch.undo()
    long = ["w"] * 60_000
    n, starts, lengths, periods, collapsed = periodic_runs._of_texts([" ".join(long)], 12)
    assert (n[0], starts[0], lengths[0], periods[0], collapsed) == (1, 0, 60_000, 1, ["w"])


def test_runs_query(spark):
    texts = repetitive(random.Random(4)) + [" ".join(f"w{k}" for k in range(n)) for n in (5, 30, 200)] * 8
    rows = [(k * 7 if k % 9 else None, t) for k, t in enumerate(texts)]
    got = Counter(tuple(r) for r in periodic_runs.query(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want, planted = Counter(), 0
    for doc_id, text in rows:
        w = WORD.findall(text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)], planted + 1
        runs = runs_by_hand(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want[(doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed_by_hand(w, runs).encode()).hexdigest())] += 1
    assert planted > 5 and got == want


def test_extensions_by_hand():
    rng = np.random.default_rng(3)
    codes = np.append(rng.integers(0, 3, 200), 3)
    e = periodic_runs.Extensions(codes)
    i, k = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(200)))
    i, k = i[i != k], k[i != k]
    for a, b, n in zip(i, k, e.between(i, k), strict=True):
        m = 0
        while max(a, b) + m < len(codes) and codes[a + m] == codes[b + m]:
            m += 1
        assert n == m


def odd_texts():
    rng = random.Random(6)
    out = [None, "", " ", "a", "日本語" * 60, "x" * 900, " " * 700, "ab " * 400, "é龘\n" * 300, "<s> </s> <0x0A> <unk> ▁▁ " * 60]
    out += ["a" * 500 + " " + "b" * 1000, "".join(rng.choice("ab cdé日 \n\t▁<>0x") for _ in range(5000)), "the quick brown fox " * 200, "=" * 300 + "\t" * 400]
    return out + out[3:6]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (40, 2), (200, 64), (32_768, 512)])
def test_token_counts_equal_the_library(spark, chunk, overlap):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.model_path())
    rows = [(k if k % 4 else None, t, 1) for k, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    found = token_counts.token_counts(docs, chunk=chunk, overlap=overlap)
    assert found.columns == ["doc_id", "text", "n_bytes", "n_tokens"]
    got = Counter((r["doc_id"], r["text"], r["n_bytes"], r["n_tokens"]) for r in found.collect())
    assert got == Counter((k, t, len((t or "").encode()), len(model.encode(t or ""))) for k, t, _ in rows)


def test_splices_widen_where_nothing_is_proven():
    encoder = token_counts.Encoder(open(token_counts.model_path(), "rb").read())
    text = "a" * 500
    assert encoder.splice(text, encoder.ends(text), 100, 200, False) is None
    assert encoder.splice(text, encoder.ends(text), 100, 500, True) == (500, len(encoder.ends(text)))
    words = "one two three four"
    at, n = encoder.splice(words, encoder.ends(words), 4, 18, True)
    assert words[at] == " " and n == len(encoder.model.encode(words[:at]))


def test_proven_boundaries_hold_in_the_whole_text():
    encoder = token_counts.Encoder(open(token_counts.model_path(), "rb").read())
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choice("abc de 日é\n.1") for _ in range(400))
        ends = set(encoder.ends(text).tolist())
        assert all(at in ends for at in range(1, 400) if text[at - 1 : at + 1].replace(" ", "▁") not in encoder.pairs)


def divergence_rows():
    rng = random.Random(12)
    said = ["Aa bb cc aa", "aa bb", "aa é日 bb", None, "...", "aa bb é日", "aa BB É日 é日", "é日 é日-é日", "q", "Straße", "Straße x", "straße1straße", "straße STRASSE ſ K\x00k"]
    rows = [(k, t, None if k % 5 == 0 else "w" if k % 3 else "", None if k == 2 else f"s{k % 4}") for k, t in enumerate(said)]
    rows += [(k, " ".join(f"t{chr(97 + int(rng.expovariate(0.2)) % 26)}" for _ in range(rng.randrange(40))), f"l{k % 3}", f"s{k % 7}") for k in range(200)]
    return rows + rows[:4] + [(None, "hot " * 3000, "l0", "s0"), (9, "lonely words here", "l9", "a"), (9, "other words there", "l9", "b")]


@pytest.mark.parametrize("block", [1, 300, 1 << 23])
def test_divergence_is_that_of_sql(spark, block):
    docs = spark.createDataFrame(divergence_rows(), SCHEMA).withColumn("term", F.lit(1))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = "lang, source, part, item, value, rank"
    got = Counter(tuple(r) for r in divergence.divergence(docs, block=block).select(*names.split(", ")).collect())
    assert got == Counter(con.sql(f"select {names} from ({divergence.oracle()})").fetchall())


def test_bitmap_lets_all_kept_terms_through(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BITS", 1 << 15)  # many terms share a bit: more candidates, the same rows
    docs = spark.createDataFrame(divergence_rows(), SCHEMA)
    rows = divergence.prepared(docs)
    kept = divergence.vocabulary(rows)
    bits = divergence.bitmap(kept)
    for r in kept.collect():
        at = zlib.crc32(f"{r['lang']}\0{r['term']}".encode()) % (1 << 15)
        assert bits[at >> 3] >> (at & 7) & 1
    found = {tuple(r) for r in divergence.postings(rows, kept).select("lang", "source", "term").collect()}
    assert {(x, t) for x, _, t in found} == {tuple(r) for r in kept.collect()}


def test_on_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for query in (periodic_runs.query, token_counts.query, divergence.query):
        assert query(empty).count() == 0
