"""Datasets by manifest, and backfills that go on where they stopped."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import backfill
from lodestone.sources.generations import Dataset


@pytest.fixture
def months(spark, tmp_path):
    return Dataset(spark, str(tmp_path / "set"), ["source", "month"], "id long, v string, source string, month string")


def rows(spark, *given):
    return spark.createDataFrame(given, "id long, v string, source string, month string")


def held(data, generation=None):
    return sorted(tuple(r) for r in data.read(generation).collect())


A, B, C = (1, "a", "x y/z", "2024-01"), (2, "b", "x y/z", "2024-02"), (3, "c", "s=%1", "2024-02")


def test_commit_read_and_vanish(spark, months):
    assert held(months) == [] and months.generation() == 0
    assert months.commit(months.stage(rows(spark, A, B, C))) == "committed"
    assert held(months) == [A, B, C] and months.generation() == 1
    changed = (2, "changed", *B[2:])
    feb = months.name_of(source="x y/z", month="2024-02")
    assert months.commit(months.stage(rows(spark, changed), [feb])) == "committed"
    assert held(months) == [A, changed, C]
    jan = months.name_of(source="x y/z", month="2024-01")
    assert months.commit(months.stage(rows(spark), [jan])) == "committed"  # no rows: the partition vanishes
    assert held(months) == [changed, C]
    assert held(months, 1) == [A, B, C]  # a reader of an earlier generation sees what it saw
    assert months.vacuum(keep=1) == 1  # the build without rows; C still lives in the first
    assert held(months) == [changed, C]


def test_two_writers_from_one_generation(spark, months):
    months.commit(months.stage(rows(spark, A, B)))
    feb, jan = months.name_of(source="x y/z", month="2024-02"), months.name_of(source="x y/z", month="2024-01")
    first = months.stage(rows(spark, (2, "first", *B[2:])), [feb])
    second = months.stage(rows(spark, (2, "second", *B[2:])), [feb])
    other = months.stage(rows(spark, (1, "other", *A[2:])), [jan])
    assert months.commit(first) == "committed"
    assert months.commit(second) == "stale"  # and its files are gone
    assert months.commit(other) == "committed"  # another partition: nothing is lost
    assert held(months) == [(1, "other", *A[2:]), (2, "first", *B[2:])]
    assert f"build={second.id}" not in months._names("data")
    late = months.stage(rows(spark, (2, "late", *B[2:])), [feb], base=1)  # made from what generation 1 held
    assert months.commit(late) == "stale"


def test_a_manifest_is_made_once(spark, months):
    assert months._create(1, {}) and not months._create(1, {"x": {}})
    assert months.manifest() == {}


def test_equal_rows_change_nothing(spark, months):
    months.commit(months.stage(rows(spark, A, B)))
    assert months.commit(months.stage(rows(spark, B, A))) == "unchanged"
    assert months.generation() == 1
    months.commit(months.stage(rows(spark, A, (2, "n", *B[2:]))))
    m = months.manifest()
    assert [m[months.name_of(source="x y/z", month=k)]["generation"] for k in ("2024-01", "2024-02")] == [1, 2]
    assert months.vacuum(keep=1) == 0  # January still lives in the first build
    months.commit(months.stage(rows(spark, (9, "z", *A[2:])), [months.name_of(source="x y/z", month="2024-01")]))
    assert months.vacuum(keep=1) == 1 and held(months) == [(2, "n", *B[2:]), (9, "z", *A[2:])]


def words_of(df):
    return df.select("range", "k", F.explode(F.split("v", " ")).alias("w")).filter("w != ''")


def job(spark, path):
    return backfill.Backfill(Dataset(spark, path, ["range"], "k long, w string, done boolean, range int"), "k", words_of, 100, 2)


def test_backfill_goes_on(spark, tmp_path):
    log = spark.range(1000).select((F.col("id") * 7).alias("k"), F.concat_ws(" ", F.lit("w"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string"))).alias("v"))
    log = log.withColumn("v", F.when(F.col("k").between(700, 1500), F.lit("")).otherwise(F.col("v")))  # ranges without rows
    want = sorted(tuple(r) for r in words_of(log.withColumn("range", F.lit(0))).drop("range").collect())
    bounds = backfill.plan(log, "k", 100)
    assert bounds[0][0] == 0 and bounds[-1][1] == 999 * 7 and all(a[1] + 1 == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    path = str(tmp_path / "fill")
    left = job(spark, path).run(log, most_jobs=1)
    assert left == len(bounds) - 2

    class Killed(Exception):
        pass

    broken = job(spark, path)
    broken.out.commit = lambda build: (_ for _ in ()).throw(Killed())  # dies after its files are written
    with pytest.raises(Killed):
        broken.run(log)
    assert len(job(spark, path).open(log)) == left
    later = log.unionByName(spark.createDataFrame([(99_999, "late")], "k long, v string"))  # beyond the planned end
    assert job(spark, path).run(later) == 0
    assert sorted(tuple(r) for r in job(spark, path).result().collect()) == want
    assert job(spark, path).run(later) == 0  # nothing is open
    again = backfill.rebuild(job(spark, path).out, log, "k", words_of, 300)
    assert sorted(tuple(r) for r in again.collect()) == want


def test_backfill_of_nothing(spark, tmp_path):
    empty = job(spark, str(tmp_path / "none"))
    log = spark.createDataFrame([], "k long, v string")
    assert empty.run(log) == 0 and empty.result().count() == 0
