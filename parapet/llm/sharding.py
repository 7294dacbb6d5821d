"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.common import ORDER_BITS, order_hash, ranked, spread_repeats
from parapet.session import cut_lineage

SHARDS = 8
NODES = 64
SLACK = 0.001
_STEP_BITS = 8


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The points of the ring in order, and for each arc its shards in clockwise order.

    Arc ``i`` ends at point ``i``; keys past the last point belong to the first. Points
    depend on the shard and node number only, so another shard adds points and moves none.
    """
    owners = np.repeat(np.arange(shards), nodes)
    names = [f"{shard}/{node}" for shard in range(shards) for node in range(nodes)]
    digests = [hashlib.blake2b(name.encode(), digest_size=8).digest() for name in names]
    points = np.array([int.from_bytes(d, "big") >> (64 - ORDER_BITS) for d in digests], np.int64)
    order = np.argsort(points, kind="stable")
    owners = owners[order]
    # Walking backwards, the nearest shard moves to the front of the list.
    found, walk = np.empty((len(owners), shards), np.int64), list(range(shards))
    for i in [*range(len(owners) - 1, -1, -1)] * 2:
        walk.remove(owners[i])
        walk.insert(0, owners[i])
        found[i] = walk
    return points[order], found


def fill(loads: np.ndarray, arcs: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """Where the bytes of each cell (arrival step, arc) go: ``(step, arc, start, shard)``.

    Steps come one after the other. A cell goes to the first shard clockwise with room;
    what does not fit there continues clockwise, from byte ``start`` of the cell on.
    """
    room = [capacity] * arcs.shape[1]
    parts = []
    walks = arcs.tolist()
    for step, arc in np.argwhere(loads > 0).tolist():
        start, load = 0, int(loads[step, arc])
        for shard in walks[arc]:
            if room[shard] > 0:
                parts.append((step, arc, start, shard))
                given = min(room[shard], load - start)
                room[shard] -= given
                start += given
                if start == load:
                    break
    return parts


def shard(
    docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of each document.

    A document's ``doc_id`` gives its place on the ring, and a second hash its place in the order of
    arrival. It goes to the first shard clockwise that is not full; a shard is full at ``1 + slack``
    times the mean bytes. The order of arrival is cut into 256 steps and the ring into
    ``shards * nodes`` arcs. The driver plans over the bytes of these cells (131,072 rows at most by
    default); a cell that fills a shard is cut at that byte, and the document
    across the cut goes to the side with its middle. Slots number a shard's documents
    without gaps.

    A null text has no bytes and crc 0; null ids share one place on the ring; repeated ids and rows are
    placed each, and overflow like others; an empty table gives no rows; further columns are ignored.
    """
    points, arcs = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        found = np.searchsorted(points, place.to_numpy()) % len(points)
        return pd.Series(found.astype(np.int32))

    doc_id = F.col("doc_id")
    rows = docs.select(
        doc_id,
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = cut_lineage(rows, "sizes").withColumns({
        "arc": arc(order_hash(F.coalesce(doc_id, F.lit(-1)))),
        "arrival": order_hash(F.lit("arrival"), doc_id),
    })
    rows = spread_repeats(rows, [], "arrival", "row")
    step = F.shiftrightunsigned("arrival", ORDER_BITS - _STEP_BITS).cast("int")
    rows = cut_lineage(rows.withColumn("step", step), "arcs")

    cells = rows.groupBy("step", "arc").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    cells = cells.toPandas()
    count = int(cells["rows"].sum())
    loads = np.zeros((1 << _STEP_BITS, len(points)), np.int64)
    loads[cells["step"], cells["arc"]] = cells["n"]
    total = int(loads.sum())
    capacity = max(-(-total // shards), int(total / shards * (1 + slack)))
    parts = np.array(fill(loads, arcs, capacity), np.int64).reshape(-1, 4)
    keys = parts[:, 0] * len(points) + parts[:, 1]
    split = np.flatnonzero(np.bincount(keys, minlength=loads.size) > 1)
    whole = np.zeros(loads.size, np.int64)
    whole[keys] = parts[:, 3]
    whole[split] = -1
    starts = keys << 44 | parts[:, 2]

    @F.pandas_udf("int")
    def whole_shard(step: pd.Series, arc: pd.Series) -> pd.Series:
        found = whole[step.to_numpy() * len(points) + arc.to_numpy()]
        return pd.Series(found.astype(np.int32))

    @F.pandas_udf("int")
    def part_shard(step: pd.Series, arc: pd.Series, middle: pd.Series) -> pd.Series:
        own = (step.to_numpy() * len(points) + arc.to_numpy()).astype(np.int64)
        found = np.searchsorted(starts, own << 44 | middle.to_numpy(), "right") - 1
        return pd.Series(parts[found, 3].astype(np.int32))

    placed = rows.withColumn("shard", whole_shard("step", "arc"))
    # At most one cell is cut for each shard that fills.
    inside = F.shiftleft(F.col("arrival").bitwiseAND(F.lit((1 << ORDER_BITS - _STEP_BITS) - 1)), _STEP_BITS)
    cut = placed.filter("shard < 0").withColumn("_inside", inside)
    cut = ranked(cut, ["step", "arc"], "_inside", ["doc_id", "row"], count, "size")
    middle = F.col("before") + F.floor(F.col("size") / 2)
    cut = cut.withColumn("shard", part_shard("step", "arc", middle)).select(placed.columns)
    placed = cut_lineage(placed.filter("shard >= 0").union(cut), "shards")
    slots = ranked(placed, ["shard"], "arrival", ["doc_id", "row"], count)
    return slots.select(
        "doc_id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot")
    )
