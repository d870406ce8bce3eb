"""Streams: windowed counts with watermarks, append-only logs with idempotent replay, latest state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import append_new


def windowed_counts(events: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` behind the newest are dropped once a window closed."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events with no gap of ``gap``."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    s = e.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def to_log(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Writes a stream to an append-only log; a batch replayed after a failure adds no row twice."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, path, key)).option("checkpointLocation", checkpoint).outputMode("append")


def stage_states(events: DataFrame, item: str, status: str, at: str) -> DataFrame:
    """Running state of each item, ``(item, status, attempts)``: an item that completed stays completed.

    One small state a key; rows of a batch are taken in time order.
    """
    kind = events.schema[item].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        for s in rows[status]:
            attempts += s == "claimed"
            if now != "completed":
                now = s
        state.update((now, int(attempts)))
        yield pd.DataFrame({item: [key[0]], "status": [now], "attempts": [int(attempts)]})

    return events.groupBy(item).applyInPandasWithState(step, f"{item} {kind}, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.NoTimeout)
