"""Alerts over a stream of events: windowed sums with a watermark, and firing with a cooldown kept as state for each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series_id string, ds timestamp, y double, fired boolean"


def prepared(events: DataFrame, ts: str, value: str, series: Column, late: str = "2 days") -> DataFrame:
    """series_id, ts, v with a watermark; rows without a time or a value don't count."""
    return events.select(series.cast("string").alias("series_id"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v")).dropna(subset=["ts", "v"]).withWatermark("ts", late)


def windowed(rows: DataFrame, length: str = "1 day") -> DataFrame:
    """series_id, ds, y, n of prepared rows: sums by window; events later than the watermark are dropped."""
    out = rows.groupBy("series_id", F.window("ts", length).alias("w")).agg(F.sum("v").alias("y"), F.count("*").alias("n"))
    return out.select("series_id", F.col("w.start").alias("ds"), "y", "n")


def fired(rows: DataFrame, threshold: float, below: bool = True, cooldown_hours: int = 24, window_hours: int = 24) -> DataFrame:
    """Windows of prepared rows whose sum is past a threshold, and whether each fires: not within the cooldown after one that did.

    A window is judged once the watermark is past its end. State is the open windows' sums, and the last firing for as long as
    its cooldown lasts; a series without either has none.
    """
    size, cooldown = window_hours * 3_600_000, cooldown_hours * 3_600_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, starts, sums = state.get if state.exists else (None, [], [])
        held, now, out = dict(zip(starts, sums, strict=True)), state.getCurrentWatermarkMs(), []
        for pdf in batches if not state.hasTimedOut else ():
            at = pdf["ts"].astype("int64") // 10 ** (6 if pdf["ts"].dtype == "datetime64[ns]" else 3)
            for start, y in pdf["v"].groupby((at - at % size).to_numpy()).sum().items():
                if start + size > now:
                    held[int(start)] = held.get(int(start), 0.0) + float(y)
        for start in sorted(s for s in held if s + size <= now):
            y = held.pop(start)
            if y < threshold if below else y > threshold:
                fire = last is None or start - last >= cooldown
                last = start if fire else last
                out.append((key[0], pd.Timestamp(start, unit="ms"), y, fire))
        if last is not None and last + cooldown + size <= now and not held:
            last = None
        if held or last is not None:
            state.update((last, list(held), list(held.values())))
            state.setTimeoutTimestamp(max(now + 1, min([s + size for s in held], default=(last or 0) + cooldown + size)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["series_id", "ds", "y", "fired"])

    return rows.groupBy("series_id").applyInPandasWithState(step, OUT, "last long, starts array<long>, sums array<double>", "append", GroupStateTimeout.EventTimeTimeout)
