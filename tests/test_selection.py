import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import selection


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("a", float(rng.randrange(50))) for _ in range(3000)] + [("b", math.exp(rng.uniform(-600, 600))) for _ in range(2500)]
    out += [("one", 7.0)] * 1500 + [(None, rng.gauss(0, 1)) for _ in range(800)] + [("few", 1.0), ("few", 2.0), ("none", None), ("nan", math.nan), ("nan", 3.0)]
    out += [(f"s{k}", float(k)) for k in range(40)]
    rng.shuffle(out)
    return out


def by_group(rows):
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    return {g: sorted(v, key=lambda x: (math.isnan(x), x)) for g, v in groups.items()}


@pytest.mark.parametrize("small", [10, 500, 1_000_000])
def test_ranks_by_sorting(spark, rows, small):
    df = spark.createDataFrame(rows, "g string, v double")
    n = F.col("n")
    ranks = F.array(F.lit(0), F.lit(1), n, n + 1, F.ceil(n / 2), F.ceil(n * 0.9), F.ceil(n * 0.001)).cast("array<bigint>")
    got = selection.at_ranks(df, ["g"], "v", ranks, small).collect()
    want = {}
    for g, v in by_group(rows).items():
        for r in {1, len(v), math.ceil(len(v) / 2), math.ceil(len(v) * 0.9), math.ceil(len(v) * 0.001)}:
            x = v[r - 1]
            want[g, r] = (len(v), repr(x), v.index(x) if x == x else sum(y == y for y in v))
    assert {(r["g"], r["rank"]): (r["n"], repr(r["value"]), r["below"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("small", [100, 1_000_000])
def test_percentiles_as_built_in(spark, rows, small):
    df = spark.createDataFrame([r for r in rows if r[0] != "nan"], "g string, v double")
    got = selection.percentiles(df, ["g"], "v", {"p95": 0.95, "p30": 0.3}, {"half": 0.5, "least": 0.0}, small)
    exact = df.groupBy("g").agg(F.percentile("v", F.lit(0.95)).alias("p95"), F.percentile("v", F.lit(0.3)).alias("p30"), F.expr("percentile_disc(0.5) within group (order by v)").alias("half"), F.min("v").alias("least"))
    want = {r["g"]: tuple(r)[1:] for r in exact.filter("least is not null").collect()}
    have = {r["g"]: (r["p95"], r["p30"], r["half"], r["least"]) for r in got.collect()}
    assert have.keys() == want.keys()
    for g, w in want.items():
        assert have[g] == pytest.approx(w, rel=1e-9)


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_buckets_by_sorting(spark, small):
    rng = random.Random(9)
    rows = [(rng.choice(["x", "x", "x", "y", None]), rng.choice([1, 1, 1, 2, rng.randrange(1000)]), k, "extra") for k in range(4000)]
    rows += [("z", 5, 4000, ""), ("w", 1, 4001, ""), ("w", 1, 4002, "")]
    df = spark.createDataFrame(rows, "g string, v long, id long, value string")
    got = {r["id"]: r["bucket"] for r in selection.buckets(df, "g", "v", "id", 4, small).collect()}
    want = {}
    for _, part in pd.DataFrame(rows, columns=["g", "v", "id", "e"]).groupby("g", dropna=False):
        ids = part.sort_values(["v", "id"])["id"].tolist()
        want |= {i: k * 4 // len(ids) for k, i in enumerate(ids)}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double, t long")
    assert selection.percentiles(df, ["g"], "v", {"p": 0.5}, {}).collect() == []
    assert selection.buckets(df, "g", "v", "t", 4).collect() == []
