"""Live timers and counters: scans of a stream come in any order within a delay, and go out in the order of their time.

A trace's scans wait in a list of its state until the watermark has passed them; an event-time timer of the earliest one wakes the trace up.
What a trace carries from scan to scan is a few numbers. A trace that is silent for long enough is forgotten, so state doesn't grow with the
number of traces ever seen. Scans that come later than the delay are dropped and counted by Spark (``late_rows``, ``StepMetrics``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

#: What transformWithState needs; the caller's session has to have it before the stream starts.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
KINDS = {"at": LongType(), "at_ms": LongType(), "event_id": LongType(), "run": BooleanType(), "pulse": BooleanType(), "reset": BooleanType(), "et": IntegerType(), "n": IntegerType()}


def of(*names: str) -> StructType:
    """A type for state; built by hand, as there is no session in a worker that could read DDL."""
    return StructType([StructField(n, KINDS[n]) for n in names])


class TimedTrace(StatefulProcessor):
    """One trace: an on-delay of ``preset`` scans over ``run`` and a count of rising edges of ``pulse`` up to ``cap``, which ``reset`` clears."""

    def __init__(self, key: str, preset: int, cap: int, idle_ms: int):
        self.key, self.preset, self.cap, self.idle_ms = key, preset, cap, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", of("at", "event_id", "run", "pulse", "reset"))
        self.carried = handle.getValueState("carried", of("et", "pulse", "n", "at"))
        self.timer = handle.getValueState("timer", of("at_ms"))

    def wake_at(self, ms: int, earlier: bool) -> None:
        """Sets the trace's one timer; with ``earlier`` only if it isn't set to an earlier time already."""
        old = self.timer.get()
        if old is not None:
            if earlier and old[0] <= ms:
                return
            self.handle.deleteTimer(old[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            frame = frame[frame["event_id"].notna()]  # others only move the watermark
            if len(frame):
                self.waiting.appendList(list(zip(map(int, frame["at"]), map(int, frame["event_id"]), *(map(bool, frame[c]) for c in ("run", "pulse", "reset")), strict=True)))
                least = int(frame["at"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.wake_at(-(-first // 1000), earlier=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        due, rest = [], []
        for r in self.waiting.get():
            (due if r[0] <= passed * 1000 else rest).append(tuple(r))
        state = self.carried.get()
        et, before, n, at = (0, False, 0, 0) if state is None else tuple(state)
        out = []
        for at, event, run, pulse, reset in sorted(due):
            et = min(self.preset, et + 1) if run else 0
            n = 0 if reset else min(self.cap, n + (pulse and not before))
            before = pulse
            out.append((event, et, run and et >= self.preset, n))
        if due:
            self.carried.update((et, before, n, at))
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.wake_at(-(-min(r[0] for r in rest) // 1000), earlier=False)
        elif due or (state is not None and at // 1000 + self.idle_ms > passed):
            self.wake_at(at // 1000 + self.idle_ms, earlier=False)
        else:
            self.carried.clear()
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "et", "q", "n"]).astype({"et": "int32", "n": "int32"})
            frame.insert(0, self.key, key[0])
            yield frame

    def close(self) -> None:
        pass


def live_timed(scans: DataFrame, preset: int, cap: int, late: str = "10 minutes", idle_ms: int = 86_400_000, key: str = "user_id") -> DataFrame:
    """A stream of scans (key, ts, event_id, run, pulse, reset) as key, event_id, et and q of the timer, n of the counter.

    Scans of a trace are taken by time, then event id; null flags count as false, and rows without an event id as signs that time has passed. A
    trace's rows of the last ``late`` are held in its state, all others only on disk. Silent for ``idle_ms`` a trace begins anew.
    """
    kind = dict(scans.dtypes)[key]
    flags = (F.coalesce(c, F.lit(False)).alias(c) for c in ("run", "pulse", "reset"))
    rows = scans.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(key, "ts", "event_id", F.unix_micros("ts").alias("at"), *flags)
    out = f"{key} {kind}, event_id long, et int, q boolean, n int"
    return rows.groupBy(key).transformWithStateInPandas(TimedTrace(key, preset, cap, idle_ms), out, "Append", "EventTime")


def late_rows(progress: list) -> int:
    """Rows that a stream dropped as late, by its batches' progress."""
    return sum(op["numRowsDroppedByWatermark"] if isinstance(op, dict) else op.numRowsDroppedByWatermark for p in progress for op in (p["stateOperators"] if isinstance(p, dict) else p.stateOperators))
