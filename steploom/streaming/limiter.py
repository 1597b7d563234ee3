"""Admission by a sliding window as one stateful processor: decisions, what waits for them, and state that ends by age."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "client string, us long, admitted boolean"


def judged(live: list[int], due: list[int], limit: int, window: int) -> tuple[list[int], list[tuple[int, bool]]]:
    """The admitted times that are still live after the due hits (in order), and each hit with whether it was admitted. Only admitted hits count against later ones."""
    held, out = deque(live), []
    for t in due:
        while held and t - held[0] >= window:
            held.popleft()
        out.append((t, len(held) < limit))
        if out[-1][1]:
            held.append(t)
    return list(held), out


class Limiter(StatefulProcessor):
    """State of a client: `live`, the admitted times that can still count, and `waiting`, the hits that the watermark has not reached.

    One timer is set for a client: for its first hit that waits, or the time at which its first live one leaves the window, whichever comes first. So what
    is too old goes, and with the last of it the client's state, whether or not the client was ever heard of again: age decides, and not emptiness.
    """

    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live, self.waiting = (handle.getListState(name, "us long") for name in ("live", "waiting"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = sorted(t for pdf in rows for t in pdf["us"].tolist())
        yield self._decided(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._decided(key, [], timerValues)

    def _decided(self, key, new: list[int], timers: TimerValues) -> pd.DataFrame:
        mark = timers.getCurrentWatermarkInMs()
        upto = 1000 * (mark - 1)
        live = [t for (t,) in self.live.get()]
        waiting = sorted([t for (t,) in self.waiting.get()] + new)
        n = sum(t <= upto for t in waiting)
        live, out = judged(live, waiting[:n], self.limit, self.window)
        waiting = waiting[n:]
        # Hits that still come are later than `upto`.
        live = [t for t in live if t + self.window > upto]
        for state, values in ((self.live, live), (self.waiting, waiting)):
            if values:
                state.put([(t,) for t in values])
            else:
                state.clear()
        # A timer fires once the watermark is beyond it.
        ends = waiting[:1] + [t + self.window for t in live[:1]]
        due = max(mark + 1, -(-min(ends) // 1000)) if ends else None
        known = list(self.handle.listTimers())
        for t in known:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in known:
            self.handle.registerTimer(due)
        return pd.DataFrame({"client": pd.Series([key[0]] * len(out), dtype=object), "us": pd.Series([t for t, _ in out], dtype="int64"), "admitted": pd.Series([ok for _, ok in out], dtype=bool)})


def admissions(hits: DataFrame, limit: int, seconds: int, late: str = "0 seconds") -> DataFrame:
    """hits (client, at) as a stream: client, at, admitted, by event time alone.

    A hit is decided once the watermark has reached it, so hits up to `late` out of order are judged in order, in whatever batches
    they come; later ones are dropped, as Spark does with late rows, and hits without a time are. Needs the RocksDB state store (`with_state_store`).
    """
    # Spark drops rows that are not after the watermark. Counted one millisecond later, the hits that can still come are those after `upto`, exactly.
    seen = (F.col("at").cast("timestamp") + F.expr("INTERVAL 1 MILLISECOND")).alias("seen")
    rows = hits.where("at is not null").select("client", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), seen).withWatermark("seen", late)
    out = rows.groupBy("client").transformWithStateInPandas(Limiter(limit, seconds), OUT, "Append", "EventTime")
    return out.select("client", F.timestamp_micros("us").alias("at"), "admitted")


def with_state_store(spark: SparkSession) -> None:
    """Sets the state store that such processors need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def kept_state(spark: SparkSession, checkpoint: str, name: str = "live") -> DataFrame:
    """client, at: the state that a query's last finished batch has kept, as a table."""
    rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    return rows.select(F.col("key.client").alias("client"), F.timestamp_micros("list_element.us").alias("at"))


def live_after(admitted: DataFrame, seconds: int, upto: Column) -> DataFrame:
    """The batch form of what is kept: of decided hits (client, t in seconds, admitted), those that still count at the time `upto`."""
    return admitted.where(F.col("admitted") & (F.col("t") + seconds > upto)).select("client", "t")
