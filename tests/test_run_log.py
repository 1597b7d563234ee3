"""The log of runs: whole commits, a stream from its first event on, restarts between any two batches, and the ledger."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from steploom.sources import run_log
from steploom.streaming import frames, limiter

SCHEMA = "run_id string, seq long, stage string, status string, detail string, s int"


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    limiter.with_state_store(spark)
    yield
    spark.conf.set(key, before)


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds("s")).drop("s")


def run(q, expected=None):
    q = q.trigger(availableNow=True).start()
    if expected:
        with pytest.raises(Exception, match=expected):
            q.awaitTermination(180)
    else:
        assert q.awaitTermination(180) and q.exception() is None


def test_every_event_once_and_the_end_last(spark, tmp_path, state_store):
    """Runs logged in pieces, out of order, twice and by two writers; a subscriber that comes late and is started anew after each batch."""
    rng = random.Random(2)
    runs, rows = {}, []
    for k in range(12):
        n = rng.randrange(1, 9)
        how = rng.choice(["done", "failed", "open"])
        for i in range(n):
            last = i == n - 1
            status = "failed" if last and how == "failed" else "ok"
            stage = frames.LAST_STAGE if last and how == "done" else rng.choice(["accepted", "generating"])
            rows.append((f"r{k}", i, stage, status, None if i % 2 else f"d{i}", i))
        runs[f"r{k}"] = (n, how)
    # One run lacks an event, so what comes behind it is not shown; one goes on after its end.
    rows = [r for r in rows if not (r[0] == "r3" and r[1] == 1)] + [(k, n, "late", "ok", None, n) for k, (n, how) in runs.items() if how != "open"]
    every = rows + rng.sample(rows, len(rows) // 2)
    rng.shuffle(every)
    log, out = str(tmp_path / "log"), str(tmp_path / "out")

    def subscribe():
        read = frames.subscribed(run_log.followed(spark, log))
        run(read.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append"))

    cuts = [0, 20, 40, 60, len(every)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        run_log.log_events(events(spark, every[a:b]), log, "w1" if i % 2 else None)
        if i:
            subscribe()
    got = sorted(map(tuple, spark.read.parquet(out).select("run_id", "seq", "kind", "stage", "status", "detail").collect()), key=str)
    want = sorted(map(tuple, frames.framed(spark.read.format("run_log").option("path", log).load()).collect()), key=str)
    assert got == want and spark.read.format("run_log").option("path", log).load().count() == len(every)
    for k, (n, how) in runs.items():
        mine = sorted((r for r in got if r[0] == k), key=lambda r: r[1])
        assert [r[1] for r in mine] == list(range(len(mine)))
        if k == "r3" and n > 1:
            assert len(mine) == 1
        else:
            assert [r[2] for r in mine] == ["progress"] * n + ["end"] * (how != "open") and (how == "open" or mine[-1][4] == how)
    said = spark.read.parquet(out).where("kind = 'end'").select(frames.text_of().alias("t"), "run_id", "seq").first()
    assert said.t.startswith("event: end\ndata: ") and json.loads(said.t[17:])["n_events"] == said.seq


def test_a_batch_that_is_written_again_counts_once(spark, tmp_path):
    """A stream into the log dies after its commit and before its checkpoint says so; the batch comes again."""
    src, log, check = str(tmp_path / "in"), str(tmp_path / "log"), tmp_path / "c"
    events(spark, [("r", i, "accepted", "ok", None, i) for i in range(50)]).repartition(3).write.parquet(src)
    run_log.register(spark)
    schema = spark.read.parquet(src).schema

    def start():
        run(spark.readStream.schema(schema).parquet(src).writeStream.format("run_log").option("path", log).option("writer", "s").option("checkpointLocation", str(check)).outputMode("append"))

    start()
    done = [p for p in (check / "commits").iterdir()]
    for p in done:
        p.unlink()
    files = sorted(os.listdir(f"{log}/parts"))
    start()
    assert sorted(os.listdir(f"{log}/parts")) == files
    assert spark.read.format("run_log").option("path", log).load().count() == 50


def test_a_task_that_fails_leaves_nothing(spark, tmp_path):
    log = str(tmp_path / "log")
    bad = events(spark, [("r", i, "accepted", "ok", None, i) for i in range(40)]).repartition(4).withColumn("detail", F.when(F.col("seq") == 33, F.raise_error(F.lit("lost"))).otherwise("d"))
    with pytest.raises(Exception, match="lost"):
        run_log.log_events(bad, log)
    # Tasks that were still at work when the job was given up may leave files, which no commit names.
    assert not os.path.exists(f"{log}/commits")
    assert spark.read.format("run_log").option("path", log).load().count() == 0
    run_log.log_events(events(spark, [("r", 0, "accepted", "ok", None, 0)]), log)
    time.sleep(1)
    run_log.swept(log, 0)
    assert len(os.listdir(f"{log}/parts")) == 1 and run_log.swept(log, 0) == 0
    run_log.log_events(events(spark, []), log)
    assert spark.read.format("run_log").option("path", log).load().count() == 1


def test_heartbeat_and_forgetting(spark, tmp_path, state_store):
    """A run that goes on gets a keep-alive when its timer has passed; one whose state has lived its time begins anew."""
    log, out, check = (str(tmp_path / x) for x in ("log", "out", "c"))

    def subscribe(kept):
        run(frames.subscribed(run_log.followed(spark, log), 0.01, kept).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append"))

    run_log.log_events(events(spark, [("a", 0, "accepted", "ok", None, 0), ("b", 0, "accepted", "failed", None, 0)]), log)
    subscribe(3600)
    run_log.log_events(events(spark, [("c", 0, "accepted", "ok", None, 0)]), log)
    subscribe(3600)
    got = [(r.run_id, r.seq, r.kind) for r in spark.read.parquet(out).collect()]
    assert ("a", 1, "keep-alive") in got and not any(r[0] == "b" and r[2] == "keep-alive" for r in got)
    kept = spark.read.format("statestore").option("stateVarName", "next").load(check)
    assert {r.key.run_id for r in kept.select("key").collect()} == {"a", "b", "c"}


def test_two_writers_of_a_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spend = lambda *rows: spark.createDataFrame(list(rows), "day string, spent double")
    assert run_log.ledger(spark, path).count() == 0
    assert run_log.book(spend(("d1", 1.5), ("d1", 2.0), ("d2", 4.0)), path) == 1
    # Another one has read version 1, and writes after version 2 has come.
    stale = run_log.booked(run_log.ledger(spark, path, 1), spend(("d1", 100.0)))
    assert run_log.book(spend(("d2", 1.0)), path) == 2
    with pytest.raises(Exception, match="Conflict"):
        stale.write.format("ledger").mode("append").option("path", path).option("version", 1).save()
    now = {r.day: (r.spent, r.n) for r in run_log.ledger(spark, path).collect()}
    assert now == {"d1": (3.5, 2), "d2": (5.0, 2)}
    named = {f for n in range(2) for f in run_log.load(run_log.Log(path).path("ledger", n))["files"]}
    assert {f"parts/{x}" for x in os.listdir(f"{path}/parts")} == named
    assert run_log.book(spend(("d1", 100.0)), path) == 3
    assert {r.day: r.spent for r in run_log.ledger(spark, path).collect()} == {"d1": 103.5, "d2": 5.0}
    assert {r.day: r.spent for r in run_log.ledger(spark, path, 1).collect()} == {"d1": 3.5, "d2": 4.0}


def test_recordings_and_their_manifests(spark, tmp_path):
    path = str(tmp_path / "tapes")
    rows = lambda *names: spark.createDataFrame([(n, "d", f"said {n}") for n in names], "name string, digest string, payload string").repartition(2)
    assert run_log.manifests(path) == []
    assert run_log.tape(rows("classify.a", "gen.b", "classify.c"), path, ["classify"]) == 1
    assert run_log.tape(rows("gen.d"), path, ["classify"]) == 2
    with pytest.raises(Exception, match="Conflict"):
        run_log.tape(rows("gen.e"), path, ["classify"], 1)
    assert [(m["rows"], m["kinds"]) for m in run_log.manifests(path)] == [(3, {"analysis": 2, "generation": 1}), (1, {"generation": 1})]
    assert sorted((r.name, r.kind, r.payload) for r in run_log.tapes(spark, path).collect()) == [("classify.a", "analysis", "said classify.a"), ("classify.c", "analysis", "said classify.c"), ("gen.b", "generation", "said gen.b"), ("gen.d", "generation", "said gen.d")]
