"""Extension: flows from a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPS = "user_id long, origin string, destination string, ts timestamp"


def transitions(events: DataFrame, delay: str = "1 hour", keep_hours: float = 24.0) -> DataFrame:
    """(user_id, origin, destination, ts): a user's consecutive event types, in event time.

    The state is a user's last event; it goes when the watermark is keep_hours past it,
    so a longer silence begins anew. Events of a micro-batch are put in order; one that
    comes in a later micro-batch than a later event follows it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        names = rows["event_type"].tolist()
        state.update((names[-1],))
        state.setTimeoutTimestamp(int(max(rows["ts"].max().timestamp() * 1000, state.getCurrentWatermarkMs()) + keep_hours * 3_600_000))
        out = pd.DataFrame({"user_id": key[0], "origin": [last, *names[:-1]], "destination": names, "ts": rows["ts"].tolist()})
        yield out[out["origin"].notna()]

    timed = events.withWatermark("ts", delay)
    return timed.groupBy("user_id").applyInPandasWithState(step, TRIPS, "last string", "append", "EventTimeTimeout")


def windowed_flows(trips: DataFrame, width: str = "1 day") -> DataFrame:
    """(begin, origin, destination, flow) by tumbling window of event time."""
    counted = trips.groupBy(F.window("ts", width), "origin", "destination").agg(F.count("*").alias("flow"))
    return counted.select(F.col("window.start").alias("begin"), "origin", "destination", "flow")
