"""First-request-anchored quota windows, in batch.

A client's window opens at its first request and lasts ``window_seconds``; the first
request at or after its end opens the next one. So each window start depends on the
one before, which no SQL window frame expresses. Requests beyond the limit are denied
but still counted.

Most clients: their requests are sorted inside a partition and folded in one streaming
pass that keeps a single ``(client, start, count)`` between Arrow batches, so no group
is ever held in memory.

Clients with more than ``hot_rows`` requests would keep one task busy for too long, so
their chain of starts is found by pointer jumping: every distinct request time gets the
time that would open the next window, and ``k`` rounds of equi-joins on
``(client, time)`` reach ``2**k`` windows. Counts come from global row numbers of a
range sort, which cuts a hot client into many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.lexicon import QUOTA_REQUESTS, QUOTA_WINDOW_SECONDS
from parapet.operators.normalize import dense_numbers
from parapet.session import cut_lineage

_SALTS = 32
# Stands for a missing identity, which is a client of its own, apart from ''.
_NOBODY = "\0"


def quota_verdicts(
    log: DataFrame,
    identity: str = "identity",
    time: str = "ts",
    order: str = "event_id",
    limit: int = QUOTA_REQUESTS,
    window_seconds: int = QUOTA_WINDOW_SECONDS,
    hot_rows: int = 5_000_000,
    slot_us: int = 4_000_000,
) -> DataFrame:
    """One verdict per request: ``(identity, time, order, n, allowed, remaining, reset_s, quota)``.

    ``n`` is the request's position in its window. Runs one count per identity first,
    to tell the hot ones. Requests without an identity share one quota; requests without a
    time fall in no window and have null verdicts.
    """
    window_us = window_seconds * 1_000_000
    events = log.select(
        F.coalesce(F.col(identity).cast("string"), F.lit(_NOBODY)).alias("k"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("us"),
        F.col(order).cast("bigint").alias("o"),
    )
    timeless = events.filter(F.col("us").isNull())
    none = F.lit(None).cast("bigint")
    timeless = timeless.withColumns({"start": none, "n": none})
    events = events.filter(F.col("us").isNotNull())
    hot = events.groupBy("k").count().filter(F.col("count") > hot_rows).select("k")
    if hot.isEmpty():
        counted = _fold(events, window_us)
    else:
        hot = cut_lineage(hot, "hot")
        counted = _fold(events.join(hot, "k", "left_anti"), window_us).unionByName(
            _jump(events.join(hot, "k", "left_semi"), window_us, slot_us)
        )
    counted = counted.unionByName(timeless)
    elapsed, placed = F.col("us") - F.col("start"), F.col("n").isNotNull()
    return counted.select(
        F.nullif("k", F.lit(_NOBODY)).alias(identity),
        F.timestamp_micros("us").alias(time),
        F.col("o").alias(order),
        "n",
        (F.col("n") <= limit).alias("allowed"),
        F.when(placed, F.greatest(F.lit(0), F.lit(limit) - F.col("n")))
        .cast("bigint")
        .alias("remaining"),
        F.when(placed, F.greatest(F.lit(0), F.floor((F.lit(window_us) - elapsed) / 1_000_000)))
        .cast("bigint")
        .alias("reset_s"),
        F.lit(limit).cast("bigint").alias("quota"),
    )


def with_quota_status(
    log: DataFrame, exempt: Column, identity: str = "identity", order: str = "event_id", **quota
) -> DataFrame:
    """The log as a server behind the quota records it: denied requests end in 429.

    Exempt requests neither pass through the quota nor count for it. Requests are told
    apart by ``order``, which must be unique.
    """
    limited = quota_verdicts(log.filter(~exempt), identity=identity, order=order, **quota)
    denied = limited.filter(~F.col("allowed")).select(order, F.lit(429).alias("denied"))
    joined = log.join(denied, order, "left")
    return joined.withColumn("status_code", F.coalesce("denied", "status_code")).drop("denied")


def window_runs(
    us: np.ndarray, new_client: np.ndarray, window_us: int, start: int | None, seen: int
) -> tuple[np.ndarray, np.ndarray]:
    """Window start and position for sorted times; ``start, seen`` carry over a window.

    ``new_client[i]`` tells that row ``i`` belongs to another client than row ``i - 1``
    (or, for row 0, than the carried window).
    """
    size = len(us)
    starts = np.empty(size, dtype=np.int64)
    position = np.empty(size, dtype=np.int64)
    at = 0
    if size and start is not None and not new_client[0]:
        later = np.flatnonzero(new_client[1:])
        end = int(later[0]) + 1 if len(later) else size
        at = int(np.searchsorted(us[:end], start + window_us, side="left"))
        starts[:at] = start
        position[:at] = seen + 1 + np.arange(at)
    # a gap of a whole window always opens a new one, whatever came before
    opens = new_client.copy()
    opens[1:] |= np.diff(us) >= window_us
    if at < size:
        opens[at] = True
    edges = np.flatnonzero(opens)
    edges = edges[edges >= at]
    bounds = np.append(edges, size)
    for low, high in zip(bounds[:-1], bounds[1:]):
        while low < high:
            if us[high - 1] - us[low] < window_us:
                nxt = high
            else:
                nxt = low + int(np.searchsorted(us[low:high], us[low] + window_us, side="left"))
            starts[low:nxt] = us[low]
            position[low:nxt] = np.arange(1, nxt - low + 1)
            low = nxt
    return starts, position


def _fold(events: DataFrame, window_us: int) -> DataFrame:
    """Streaming fold over client-sorted partitions."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, start, seen = None, None, 0
        for rows in batches:
            if rows.empty:
                continue
            keys = rows["k"].to_numpy(dtype=object)
            new_client = np.empty(len(keys), dtype=bool)
            new_client[0] = start is None or keys[0] != client
            new_client[1:] = keys[1:] != keys[:-1]
            us = rows["us"].to_numpy(dtype=np.int64)
            starts, position = window_runs(us, new_client, window_us, start, seen)
            client, start, seen = keys[-1], int(starts[-1]), int(position[-1])
            yield rows.assign(start=starts, n=position)

    ordered = events.repartition("k").sortWithinPartitions("k", "us", "o")
    return ordered.mapInPandas(fold, "k string, us bigint, o bigint, start bigint, n bigint")


def _jump(events: DataFrame, window_us: int, slot_us: int) -> DataFrame:
    """Windows of hot clients by pointer jumping."""
    ordered = events.repartitionByRange("k", "us", "o").sortWithinPartitions("k", "us", "o")
    numbered = cut_lineage(ordered.withColumn("row", F.monotonically_increasing_id()), "sorted")
    ranked = dense_numbers(numbered, "row", "rank")
    nodes = cut_lineage(ranked.groupBy("k", "us").agg(F.min("rank").alias("first")), "nodes")

    starts = _chain(nodes, window_us, slot_us).join(nodes, ["k", "us"])
    # Starts are at least a window apart, so a clock bucket of that width holds at most
    # one, and a request's start lies in its own bucket or the one before.
    cell = F.struct(F.col("us").alias("start"), "first")
    bucket = _floor_div("us", window_us)
    per_bucket = (
        starts.select("k", bucket.alias("b"), cell.alias("own"), F.lit(None).alias("before"))
        .unionByName(
            starts.select(
                "k", (bucket + 1).alias("b"), F.lit(None).alias("own"), cell.alias("before")
            )
        )
        .groupBy("k", "b")
        .agg(F.max("own").alias("own"), F.max("before").alias("before"))
    )
    salted = per_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    requests = ranked.withColumns(
        {"b": bucket, "salt": F.pmod(F.col("rank"), F.lit(_SALTS)).cast("int")}
    )
    joined = requests.join(salted, ["k", "b", "salt"])
    chosen = F.when(F.col("own.start") <= F.col("us"), F.col("own")).otherwise(F.col("before"))
    placed = joined.withColumn("w", chosen)
    return placed.select(
        "k", "us", "o", F.col("w.start").alias("start"),
        (F.col("rank") - F.col("w.first") + 1).alias("n"),
    )


def _floor_div(column: str, width: int):
    value = F.col(column)
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def _successors(nodes: DataFrame, window_us: int, slot_us: int) -> DataFrame:
    """For each distinct time, the client's first time at least a window later.

    Times and probes meet inside slots of ``slot_us``; as both are distinct whole
    microseconds, a slot holds at most ``2 * slot_us`` rows however busy the client is.
    A probe without an answer in its slot takes the first time of the next filled slot.
    """
    marks = nodes.select("k", F.col("us").alias("at"), F.col("us").alias("node"),
                         F.lit(None).cast("bigint").alias("probe"))
    probes = nodes.select("k", (F.col("us") + window_us).alias("at"),
                          F.lit(None).cast("bigint").alias("node"), F.col("us").alias("probe"))
    both = marks.unionByName(probes).withColumn("slot", _floor_div("at", slot_us))
    # from late to early; at equal times the node comes before the probe that meets it
    backwards = (
        Window.partitionBy("k", "slot")
        .orderBy(F.desc("at"), F.asc_nulls_first("probe"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = both.withColumn("here", F.last("node", ignorenulls=True).over(backwards))
    later = (
        Window.partitionBy("k").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    )
    slots = both.groupBy("k", "slot").agg(F.min("node").alias("low"))
    ahead = slots.select(
        "k", "slot", F.last("low", ignorenulls=True).over(later).alias("ahead")
    )
    return (
        inside.filter(F.col("probe").isNotNull())
        .join(ahead, ["k", "slot"])
        .select("k", F.col("probe").alias("us"), F.coalesce("here", "ahead").alias("next"))
        .filter(F.col("next").isNotNull())
    )


def _chain(nodes: DataFrame, window_us: int, slot_us: int) -> DataFrame:
    """Window starts ``(k, us)``: all nodes reached from each client's first one."""
    jumps = cut_lineage(_successors(nodes, window_us, slot_us), "jumps")
    reached = cut_lineage(nodes.groupBy("k").agg(F.min("us").alias("us")), "reached")
    while True:
        # jumps lead 2**k windows ahead and reached holds the first 2**k starts
        found = reached.join(jumps, ["k", "us"]).select("k", F.col("next").alias("us"))
        found = cut_lineage(found, "reached")
        if found.isEmpty():
            return reached
        reached = reached.unionByName(found)
        second = jumps.select("k", F.col("us").alias("next"), F.col("next").alias("after"))
        jumps = cut_lineage(
            jumps.join(second, ["k", "next"]).select("k", "us", F.col("after").alias("next")),
            "jumps",
        )
