"""The sliding-window limiter (inventory 2.O), over a table and over a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def allow(log: deque[float], at: float, limit: int, seconds: float) -> bool:
    """O-1: entries as old as the window go; an event is allowed, and logged, while fewer than ``limit`` are left."""
    while log and log[0] <= at - seconds:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(at)
    return True


def limited(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Events (``event_id``, ``key``, ``ts``) with ``allowed``. Rows stream through in order of key and time, so a task holds one log of at most ``limit`` entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, deque()
        for b in batches:
            allowed = []
            for k, ts in zip(b.key, b.ts, strict=True):
                if k != key:
                    key, log = k, deque()
                allowed.append(allow(log, ts.timestamp(), limit, seconds))
            yield b.assign(allowed=allowed)

    ordered = events.select("event_id", "key", "ts").repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return ordered.mapInPandas(run, "event_id long, key string, ts timestamp, allowed boolean")


class _Limiter(StatefulProcessor):
    """A key's log as list state, and one timer a key: when the newest entry is as old as the window, the log goes."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("log", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        log = deque(at for (at,) in self.entries.get())
        allowed = [allow(log, ts.timestamp(), self.limit, self.seconds) for ts in events.ts]
        self.entries.put([(at,) for at in log])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((log[-1] + self.seconds) * 1000) + 1)
        yield events.assign(allowed=allowed)[["event_id", "key", "ts", "allowed"]]

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, limit: int, seconds: float, delay: str = "1 minute") -> DataFrame:
    """The same over a stream, in event time: a key's log is its state, and goes once the watermark is past its window, so state holds no more than the keys of a window and the delay.

    Events later than ``delay`` behind the newest are dropped. The session's state store must be RocksDB, which this sets.
    A key's events are one task's, as each decision rests on those before it.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = events.select("event_id", "key", "ts").withWatermark("ts", delay).groupBy("key")
    return keyed.transformWithStateInPandas(_Limiter(limit, seconds), "event_id long, key string, ts timestamp, allowed boolean", "Append", "EventTime")
