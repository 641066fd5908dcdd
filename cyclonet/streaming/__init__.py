"""Streaming forms of three jobs; each gives what its batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def completeness(states: DataFrame, route: str, expected: int, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Distinct (cycle, phase) states seen of each route against the expected number."""
    keys = [route, "cycle", "phase"]
    once = states.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if states.isStreaming and time else states.dropDuplicates(keys)
    return once.groupBy(route).agg(F.count("*").alias("seen")).withColumn("complete", F.col("seen") >= expected)


def pair_phases(rows: DataFrame, key: str, value: str, time: str, delay: str) -> DataFrame:
    """key, cycle, cold, hot, hot_minus_cold, once both phases of a cycle are there, in whatever order they arrive.

    State is dropped when the watermark passes its last row by `delay`; later rows are dropped with it.
    """

    def pair(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        cold, hot, done = state.get if state.exists else (None, None, False)
        latest = None
        for f in frames:
            for phase, v, t in zip(f["phase"], f[value], f[time], strict=True):
                cold = float(v) if phase == "cold" and cold is None else cold
                hot = float(v) if phase == "hot" and hot is None else hot
                latest = t if latest is None or t > latest else latest
        out = not done and cold is not None and hot is not None
        state.update((cold, hot, done or out))
        if latest is not None:
            state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame([{key: k[0], "cycle": k[1], "cold": cold, "hot": hot, "hot_minus_cold": hot - cold}])

    kind = rows.schema[key].dataType.simpleString()
    grouped = rows.withWatermark(time, delay).select(key, F.col("cycle").cast("int").alias("cycle"), "phase", value, time).groupBy(key, "cycle")
    return grouped.applyInPandasWithState(pair, f"{key} {kind}, cycle int, cold double, hot double, hot_minus_cold double", "cold double, hot double, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def rare_windows(events: DataFrame, time: str, group: str, flag, width: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """start, end, group, n, events: rows and flagged rows in tumbling (or sliding) windows."""
    if delay and events.isStreaming:
        events = events.withWatermark(time, delay)
    out = events.groupBy(F.window(time, width, slide) if slide else F.window(time, width), group).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("events"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "n", "events")


def rare_sessions(events: DataFrame, time: str, group: str, flag, gap: str, delay: str | None = None) -> DataFrame:
    """As rare_windows, in sessions that end after a gap."""
    if delay and events.isStreaming:
        events = events.withWatermark(time, delay)
    out = events.groupBy(F.session_window(time, gap), group).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("events"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), group, "n", "events")
