"""Correlation over a stream: the batch fold, with its state kept by (correlation, group)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.correlate import triggers
from ..plans.ir import Ruleset

OUT = "correlation int, rule_name string, group_key string, window_start timestamp, alert_ts timestamp, event_id long, n int"
STATE = "start long, n int"
#: A group idle for so long past the watermark is forgotten (at least its timespan).
IDLE_US = 3_600_000_000


def fold(start: int | None, n: int, span: int, gte: int, rows: list[tuple[int, int]]) -> tuple[int | None, int, list[tuple[int, int, int, int]]]:
    """Events (time, id) in order to the new state and the alerts (start, time, id, count)."""
    out = []
    for t, event in rows:
        if start is None or span == 0 or t - start > span:
            start, n = t, 0
        n += 1
        if n >= gte:
            out.append((start, t, event, n))
            start, n = t, 0
    return start, n, out


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    start, n = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
    span, gte = int(rows["span_us"].iloc[0]), int(rows["gte"].iloc[0])
    start, n, alerts = fold(start, n, span, gte, list(zip(rows["t"].tolist(), rows["event_id"].tolist(), strict=True)))
    state.update((start, n))
    latest = max(start, state.getCurrentWatermarkMs() * 1000)
    state.setTimeoutTimestamp((latest + max(span, IDLE_US)) // 1000 + 1)
    if alerts:
        yield pd.DataFrame([(key[0], rows["rule_name"].iloc[0], key[1], pd.Timestamp(a, unit="us"), pd.Timestamp(t, unit="us"), e, c) for a, t, e, c in alerts], columns=["correlation", "rule_name", "group_key", "window_start", "alert_ts", "event_id", "n"])


def correlate_stream(events: DataFrame, ruleset: Ruleset, fields: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    """Alerts over a stream of evaluated events (event_id, ts, matched, ...); append mode.

    Events later than the watermark are dropped; within a micro-batch they are ordered by time.
    """
    counted = triggers(events, ruleset, fields).withWatermark("ts", late)
    return counted.groupBy("correlation", "group_key").applyInPandasWithState(_update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
