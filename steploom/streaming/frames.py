"""What a subscriber of a run sees: every event once and in order, from the first on, and a last frame with the run's end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.writers import frame

LAST_STAGE = "assembling"
OUT = "run_id string, seq long, kind string, stage string, status string, detail string"
_KINDS = {"run_id": object, "seq": "int64", "kind": object, "stage": object, "status": object, "detail": object}


def ends(stage: Column, status: Column) -> Column:
    """How an event ends its run (done or failed), NULL if it does not."""
    return F.when(status == "failed", "failed").when((status == "ok") & (stage == LAST_STAGE), "done")


def framed(events: DataFrame) -> DataFrame:
    """The batch form: run_id, seq, kind (progress or end), stage, status, detail.

    An event that was logged more than once counts as first logged (`at`). Frames go up to the first missing number, or to the event that ends the run,
    whichever comes first; an ended run has a frame more, of kind `end`, whose number is that of its frames and whose status is done or failed.
    """
    once = events.where("seq >= 0").groupBy("run_id", "seq").agg(F.min_by(F.struct("stage", "status", "detail"), F.struct("at", "stage", "status", "detail")).alias("e")).select("run_id", "seq", "e.*")
    once = once.withColumn("end", ends(F.col("stage"), F.col("status")))
    order = W.partitionBy("run_id").orderBy("seq")
    seen = once.withColumn("place", F.row_number().over(order) - 1).withColumn("ended", F.count("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    told = seen.where((F.col("place") == F.col("seq")) & (F.col("ended") == 0))
    last = told.where("end is not null").select("run_id", (F.col("seq") + 1).alias("seq"), F.lit("end").alias("kind"), F.lit(None).cast("string").alias("stage"), F.col("end").alias("status"), F.lit(None).cast("string").alias("detail"))
    return told.select("run_id", "seq", F.lit("progress").alias("kind"), "stage", "status", "detail").unionByName(last)


def text_of() -> Column:
    """A frame's text in the event-stream format."""
    end = F.concat(F.lit("event: end\ndata: "), F.to_json(F.struct(F.col("seq").alias("n_events"), "run_id", "status")), F.lit("\n\n"))
    return F.when(F.col("kind") == "end", end).when(F.col("kind") == "keep-alive", ": keep-alive\n\n").otherwise(frame())


class Frames(StatefulProcessor):
    """State of a run: the number of the next event, events that came too early, and whether it has ended.

    Processing time alone is used: a timer for the heartbeat while a run goes on, and a time to live for all state, counted from the last change, so that
    runs that ended, or that were given up, are forgotten. A frame's order within a run is that of its number, so batches need no order.
    """

    def __init__(self, heartbeat: float | None, kept: float):
        self.heartbeat, self.kept = heartbeat, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, ttl = handle, int(self.kept * 1000)
        self.next = handle.getValueState("next", "seq long, ended boolean", ttl)
        self.early = handle.getMapState("early", "seq long", "stage string, status string, detail string", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        run = key[0]
        at, ended = self.next.get() if self.next.exists() else (0, False)
        came: dict[int, tuple] = {}
        for pdf in rows:
            for r in sorted(pdf[["seq", "at", "stage", "status", "detail"]].astype(object).where(pdf.notna(), None).itertuples(index=False), key=lambda r: (r.seq, r.at is None, r.at, *(x or "" for x in r[2:]))):
                if r.seq >= at and not self.early.containsKey((int(r.seq),)):
                    came.setdefault(int(r.seq), tuple(r[2:]))
        out = []
        while not ended:
            if at in came:
                e = came.pop(at)
            elif self.early.containsKey((at,)):
                e = tuple(self.early.getValue((at,)))
                self.early.removeKey((at,))
            else:
                break
            out.append((run, at, "progress", *e))
            at += 1
            how = "failed" if e[1] == "failed" else "done" if e[1] == "ok" and e[0] == LAST_STAGE else None
            if how:
                ended = True
                out.append((run, at, "end", None, how, None))
        if ended:
            self.early.clear()
        else:
            for seq, e in came.items():
                self.early.updateValue((seq,), e)
        self.next.update((at, ended))
        self._beat(timerValues, ended)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, ended = self.next.get() if self.next.exists() else (0, True)
        self._beat(timerValues, ended)
        yield self._frame([] if ended else [(key[0], at, "keep-alive", None, None, None)])

    def _beat(self, timers: TimerValues, ended: bool) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.heartbeat is not None and not ended:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.heartbeat * 1000))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kind) for i, (c, kind) in enumerate(_KINDS.items())})


def subscribed(events: DataFrame, heartbeat: float | None = None, kept: float = 86_400) -> DataFrame:
    """The stream's form: frames of all runs of a stream of events (run_id, seq, stage, status, detail, at), whatever their order and however often
    they were logged. Needs the RocksDB state store (`limiter.with_state_store`)."""
    some = events.where("seq >= 0").select("run_id", "seq", "stage", "status", "detail", "at")
    return some.groupBy("run_id").transformWithStateInPandas(Frames(heartbeat, kept), OUT, "Append", "ProcessingTime")
