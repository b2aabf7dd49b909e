import random

import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators import ingest
from lodestone.streaming import ingest as streaming
from lodestone.streaming import keyed

EVENTS = "source string, native_id string, content string, arrival long, occurred_at timestamp, is_tombstone boolean, parent string"


def test_batches_equal_one_pass(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["s", "s", None]), f"k{rng.choice([0, 0, 0, rng.randrange(8)])}", rng.choice(["a", "b", "c", None, str(rng.randrange(40))]), k, None, rng.random() < 0.1, rng.choice([None, "p"])) for k in range(600)]
    read = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    log, checkpoint, sizes = str(tmp_path / "log"), str(tmp_path / "cp"), []
    for part in (rows[:250], rows[250:400], rows[400:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        keyed.start(read(), log, checkpoint).awaitTermination()
        sizes.append(streaming.read_log(spark, log).count())
    names = ["source", "native_id", "sha256", "content", "arrival", "is_tombstone", "parent", "revision"]
    as_set = lambda df: sorted(map(repr, df.select(*names).collect()))
    want = ingest.new_revisions(None, spark.createDataFrame(rows, EVENTS))
    assert as_set(streaming.read_log(spark, log)) == as_set(want)
    assert sizes[0] < sizes[1] < sizes[2]
    keyed.start(read(), log, checkpoint).awaitTermination()
    assert streaming.read_log(spark, log).count() == sizes[2]


def test_a_key_costs_one_read_and_one_write():
    """Calls of state follow keys, not contents; contents beyond those in the key's own row are asked one by one."""

    class Counted(dict):
        calls = 0

        def getValue(self, k):  # noqa: N802
            self.calls += 1
            return self.get(k)

        def updateValue(self, k, v):  # noqa: N802
            self.calls += 1
            self[k] = v

        def containsKey(self, k):  # noqa: N802
            self.calls += 1
            return k in self

    work = keyed.Revisions()
    work.last, work.seen = Counted(), Counted()
    rows = [(f"s{k % 50}", None, f"h{k % 10}", "c", k, None, False, None) for k in range(1000)]
    batch = pd.DataFrame(rows, columns=[c for c in keyed.COLUMNS if c != "revision"])
    (out,) = work.handleInputRows((0,), iter([batch[:300], batch[300:]]), None)
    assert len(out) == 50 and work.last.calls == 100 and work.seen.calls == 0
    wide = pd.DataFrame([("s0", None, f"w{k:03}", "c", k, None, False, None) for k in range(40)], columns=batch.columns)
    for again in range(2):
        got = list(work.handleInputRows((0,), iter([wide, wide]), None))
        assert [r for b in got for r in b["revision"]] == ([] if again else list(range(2, 42)))
    assert len(work.seen) == 41 - keyed.INLINE and len(work.last[("s0", None)][1]) == keyed.INLINE


def test_forgotten_keys_stay_away(spark, tmp_path):
    rows = [("s", "k1", "a", 1, None, False, None), ("s", "k2", "a", 2, None, False, None)]
    spark.createDataFrame(rows, EVENTS).write.json(str(tmp_path / "in"))
    gone = spark.createDataFrame([("s", "k1")], "source string, native_id string")
    keyed.start(spark.readStream.schema(EVENTS).json(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"), gone).awaitTermination()
    assert [r[0] for r in streaming.read_log(spark, str(tmp_path / "log")).select("native_id").collect()] == ["k2"]
    assert streaming.read_log(spark, str(tmp_path / "log")).filter(F.col("revision") != 1).isEmpty()
