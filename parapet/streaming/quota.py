"""Quota windows over a stream: one ``(start, count)`` per client in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from parapet.lexicon import QUOTA_REQUESTS, QUOTA_WINDOW_SECONDS
from parapet.operators.quota import window_runs
from parapet.streaming.state import keep_in_rocksdb, state_rows

_OUTPUT = (
    "identity string, ts timestamp, event_id bigint, n bigint, allowed boolean,"
    " remaining bigint, reset_s bigint, quota bigint"
)

# Rows per verdict frame.
_SLICE = 100_000


class _QuotaWindow(StatefulProcessor):
    def __init__(self, limit: int, window_us: int, idle_us: int | None):
        self._limit, self._window_us, self._idle_us = limit, window_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._window = handle.getValueState("window", "start bigint, seen bigint")

    def _deadline(self, start: int) -> int:
        """When a window that began at ``start`` is long over, in milliseconds."""
        return -(-(start + self._idle_us) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Two integers per request of one client in one micro-batch, whose size
        # maxBytesPerTrigger bounds; the verdicts leave in slices.
        parts = [(r["us"].to_numpy(np.int64), r["event_id"].to_numpy(np.int64)) for r in rows]
        us, event_id = (np.concatenate(column) for column in zip(*parts))
        order = np.lexsort((event_id, us))
        us, event_id = us[order], event_id[order]
        start, seen = self._window.get() if self._window.exists() else (None, 0)
        new_client = np.zeros(len(us), dtype=bool)
        new_client[0] = start is None
        starts, n = window_runs(us, new_client, self._window_us, start, seen)
        self._window.update((int(starts[-1]), int(n[-1])))
        if self._idle_us is not None and starts[-1] != start:
            self._handle.registerTimer(self._deadline(int(starts[-1])))
        left = (self._window_us - (us - starts)) // 1_000_000
        for low in range(0, len(us), _SLICE):
            cut = slice(low, low + _SLICE)
            yield pd.DataFrame(
                {
                    "identity": key[0],
                    "ts": pd.to_datetime(us[cut], unit="us"),
                    "event_id": event_id[cut],
                    "n": n[cut],
                    "allowed": n[cut] <= self._limit,
                    "remaining": np.maximum(0, self._limit - n[cut]),
                    "reset_s": np.maximum(0, left[cut]),
                    "quota": self._limit,
                }
            )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a client that came back since has a later window, and a later timer
        if self._window.exists() and self._deadline(self._window.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self._window.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_quota(
    log: DataFrame,
    limit: int = QUOTA_REQUESTS,
    window_seconds: int = QUOTA_WINDOW_SECONDS,
    evict: bool = False,
    late: str = "1 minute",
) -> DataFrame:
    """Verdicts for a streaming request log ``(identity, ts, event_id)``.

    Requests count in order of arrival, sorted inside a micro-batch; those without a time
    fall in no window and get no verdict. ``evict`` drops the state of clients whose window began
    three windows before the newest requests, in event time: a replay at any speed drops what live traffic
    would, and never a window that still counts, as a later request would open a new one. Requests more
    than ``late`` behind the newest of earlier micro-batches are then dropped. The rows of one client within
    one micro-batch meet in one task, as two integers each; ``maxBytesPerTrigger`` bounds them.
    """
    keep_in_rocksdb(log.sparkSession)
    keyed = log.select("identity", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    keyed = keyed.withColumn("us", F.unix_micros("ts")).filter(F.col("us").isNotNull())
    window_us = window_seconds * 1_000_000
    keyed = keyed.withWatermark("ts", late) if evict else keyed.drop("ts")
    return keyed.groupBy("identity").transformWithStateInPandas(
        _QuotaWindow(limit, window_us, 3 * window_us if evict else None),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="EventTime" if evict else "None",
    )


def live_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(identity, start, seen)`` of the clients that ``stream_quota`` keeps under ``checkpoint``."""
    held = state_rows(spark, checkpoint, "window")
    return held.select("key.identity", F.timestamp_micros("value.start").alias("start"), "value.seen")
