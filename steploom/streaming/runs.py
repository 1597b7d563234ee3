"""Admission by a sliding window, and run states: batch and streaming forms of one rule."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .limiter import admissions, with_state_store

STAGES = ["accepted", "generating", "segmenting", "classifying", "assembling"]


def admitted(times: Column, limit: int, seconds: int) -> Column:
    """Of an ordered array of times in seconds: array of (t, admitted). Only admitted hits count against later ones."""
    start = F.struct(F.array().cast("array<double>").alias("live"), F.array().cast("array<struct<t:double,admitted:boolean>>").alias("out"))

    def step(s, t):
        live = F.filter(s["live"], lambda x: t - x < seconds)
        ok = F.size(live) < limit
        return F.struct(F.when(ok, F.array_append(live, t)).otherwise(live).alias("live"), F.array_append(s["out"], F.struct(t.alias("t"), ok.alias("admitted"))).alias("out"))

    return F.aggregate(times, start, step, lambda s: s["out"])


def limited(hits: DataFrame, client: str, at: str, limit: int, seconds: int) -> DataFrame:
    """client, t, admitted, in order of time. The rule is sequential, so a client's hits stay in one task, but they pass through it sorted (Spark
    spills the sort) and a batch at a time: only `limit` times are held, however busy a client is. A hit without a time is not admitted."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, live = None, []
        for batch in batches:
            ok = []
            for who, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != now:
                    now, live = who, []
                live = live if t is None else [x for x in live if t - x < seconds]
                ok.append(t is not None and len(live) < limit)
                if ok[-1]:
                    live.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["client", "t", "admitted"])

    rows = hits.select(F.col(client).alias("client"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).select("client", (F.col("us") / 1e6).alias("t"))
    kind = rows.schema["client"].dataType.simpleString()
    return rows.repartition("client").sortWithinPartitions("client", "t").mapInArrow(fold, f"client {kind}, t double, admitted boolean")


def limited_stream(hits: DataFrame, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """The same rule over a stream of hits (client, at), by `limiter.admissions`; sets the state store that it needs."""
    with_state_store(hits.sparkSession)
    return admissions(hits, limit, seconds, late)


def replayed(events: DataFrame) -> DataFrame:
    """A run's events once each: the first row of each (run_id, seq)."""
    rest = [c for c in events.columns if c not in ("run_id", "seq")]
    return events.groupBy("run_id", "seq").agg(F.min_by(F.struct(*rest), "at").alias("e")).select("run_id", "seq", "e.*")


def states(events: DataFrame) -> DataFrame:
    """run_id, n_events, stage, status: done only from the last stage; a run that ended otherwise has failed."""
    last = events.groupBy("run_id").agg(F.count("*").alias("n_events"), F.max_by(F.struct("stage", "status"), "seq").alias("e"), F.bool_or(F.col("status") == "failed").alias("bad"))
    done = ~F.col("bad") & (F.col("e.stage") == STAGES[-1]) & (F.col("e.status") == "ok")
    return last.select("run_id", "n_events", F.col("e.stage").alias("stage"), F.when(done, "done").otherwise("failed").alias("status"))


def newest_runs(runs: DataFrame, order: str, most: int = 32) -> DataFrame:
    """The registry: the newest runs only."""
    return runs.orderBy(F.col(order).desc()).limit(most)


EVENT = "run_id string, seq long, stage string, status string, detail string, at timestamp"


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only log of run events as a stream, from its start: a late reader sees what an early one saw."""
    return spark.readStream.schema(EVENT).json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.select("run_id", "seq", "stage", "status", "detail", "at").write.mode("append").json(path)


def tailed(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (run_id, seq) once, within the watermark; state older than `late` is dropped."""
    return log.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def precheck(used: Column, limit: int = 60, per_run: int = 8, least: int = 3) -> Column:
    """struct(calls, reason): what a run may spend, refused if that is less than it needs."""
    calls = F.least(F.lit(per_run), F.lit(limit) - F.coalesce(used, F.lit(0)))
    return F.struct(calls.alias("calls"), F.when(calls < least, "call budget exhausted").alias("reason"))
