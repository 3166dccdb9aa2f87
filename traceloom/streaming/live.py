"""Live traces: state from scan to scan in Structured Streaming, and counts over event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def live_alarms(scans: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Each scan of a stream with key, order columns, trip and reset, as (key, order columns, alarm): on by trip, which wins, off by reset.

    A key's state is one boolean. Scans of a micro-batch are put in order; across batches they are taken as they come, so the source must
    deliver a trace in order. A batch's scans of one key are held at once: limit batches at the source (maxFilesPerTrigger or the like).
    """
    columns = [key, *order]

    def step(keys, frames, state):
        on = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        known = pd.Series(pd.NA, index=rows.index, dtype="boolean")
        known[rows["reset"].fillna(False).astype(bool)] = False
        known[rows["trip"].fillna(False).astype(bool)] = True
        alarm = known.ffill().fillna(on).astype(bool)
        state.update((bool(alarm.iloc[-1]),))
        yield rows[columns].assign(alarm=alarm)

    kinds = dict(scans.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", alarm boolean"
    return scans.groupBy(key).applyInPandasWithState(step, out, "alarm boolean", "append", GroupStateTimeout.NoTimeout)


def trips_by_window(scans: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Scans and trips in each window of event time; scans that come later than ``late`` behind the newest are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = scans.withWatermark("ts", late).groupBy(window.alias("w")).agg(F.count("*").alias("n_scans"), F.count_if("trip").alias("n_trips"))
    return found.select(F.col("w.start").alias("start"), "n_scans", "n_trips")


def sessions(scans: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    found = scans.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_scans"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_scans")
