"""The stateful limiter against the batch fold, over restarts, idle times and late hits; its state as a table."""

import random

import pytest
from pyspark.sql import functions as F

from steploom.streaming import limiter, runs


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    limiter.with_state_store(spark)
    yield
    spark.conf.set(key, before)


class Stream:
    """Batches of hits, each read by a query that is started anew from the checkpoint of the one before."""

    def __init__(self, spark, folder, limit, seconds, late):
        self.spark, self.folder, self.args = spark, folder, (limit, seconds, f"{late} seconds")

    def batch(self, rows):
        hits = self.spark.createDataFrame(rows, "client string, s double").select("client", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("at"))
        hits.coalesce(1).write.mode("append").parquet(str(self.folder / "hits"))
        read = self.spark.readStream.schema("client string, at timestamp").parquet(str(self.folder / "hits"))
        q = limiter.admissions(read, *self.args).writeStream.format("parquet").option("path", str(self.folder / "out")).outputMode("append").option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None

    def decided(self):
        return sorted((r.client, r.s, r.admitted) for r in self.spark.read.parquet(str(self.folder / "out")).select("client", (F.unix_micros("at") / 1e6).alias("s"), "admitted").collect())

    def kept(self, name="live"):
        return sorted((r.client, r.s) for r in limiter.kept_state(self.spark, str(self.folder / "c"), name).select("client", (F.unix_micros("at") / 1e6).alias("s")).collect())


def test_state_ends_by_age(spark, tmp_path, state_store):
    """Two live hits, then an idle time, late and unordered hits; what is kept goes when it is old, though nobody asks for it again."""
    s = Stream(spark, tmp_path, 3, 60, 20)
    for rows in [[("c", 100), ("c", 101)], [("d", 102)], [("c", 110), ("c", 105), ("c", 103)], [("c", 150), ("c", 90)]]:
        s.batch([(k, float(t)) for k, t in rows])
    # The watermark is at 130: all but the hit at 150 are decided, and the three admitted ones count until 163.
    assert s.kept() == [("c", 100.0), ("c", 101.0), ("c", 103.0), ("d", 102.0)] and s.kept("waiting") == [("c", 150.0)]
    s.batch([("c", 161.0), ("d", 200.0)])
    assert s.kept("waiting") == [("d", 200.0)] and s.kept() == [("c", 161.0)]  # at 180, d's hit of 102 is gone, by age alone
    s.batch([("e", 400.0)])
    assert s.kept() == [] and s.kept("waiting") == [("e", 400.0)]
    # 90 is over 20 seconds late and goes; 100, 101 and 103 are admitted, 105, 110 and 150 are not, and 161 finds 100 and 101 live no more.
    assert s.decided() == [("c", 100, True), ("c", 101, True), ("c", 103, True), ("c", 105, False), ("c", 110, False), ("c", 150, False), ("c", 161, True), ("d", 102, True), ("d", 200, True)]


def test_stream_equals_the_batch_fold(spark, tmp_path, state_store):
    """Random hits, in order but for some seconds, in batches with a restart between any two; ties, busy and idle clients."""
    rng = random.Random(4)
    at, hits = 0.0, []
    for _ in range(300):
        at += rng.choice([0, 0, 0.25, 1, 5, 90])
        hits.append((rng.choice("aaab") if rng.random() < 0.9 else rng.choice("cdef"), at + rng.random() * 3))
    s = Stream(spark, tmp_path, 3, 60, 4)
    cuts = sorted(rng.sample(range(1, 300), 4))
    for a, b in zip([0, *cuts], [*cuts, 300]):
        s.batch(hits[a:b])
    s.batch([("end", at + 1000)])
    s.batch([("end", at + 3000)])
    every = spark.createDataFrame([*hits, ("end", at + 1000)], "client string, s double").select("client", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("at"))
    batch = runs.limited(every, "client", "at", 3, 60)
    assert s.decided() == sorted((r.client, r.t, r.admitted) for r in batch.collect())
    assert s.kept() == sorted((r.client, r.t) for r in limiter.live_after(batch, 60, F.lit(at + 3000 - 4)).collect())


def test_only_admitted_hits_count():
    live, out = limiter.judged([5, 6], [7, 8, 15, 16, 30], 3, 10)
    assert out == [(7, True), (8, False), (15, True), (16, True), (30, True)] and live == [30]
    assert limiter.judged([], [], 3, 10) == ([], [])
