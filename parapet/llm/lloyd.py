"""Centroid clustering: Lloyd rounds over vectors cut into blocks of columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parapet.session import cut_lineage

CLUSTERS = 16
ROUNDS = 3
SCALE = 64
#: Columns in one block, and vectors in one chunk.
WIDTH = 16
CHUNK_ROWS = 4096
#: Bits of a scaled component: with at most 128 components squared distances then fit 63 bits.
BITS = 27

_SHARDS = "chunk bigint, block int, vectors int, cells binary, names array<bigint>"


def scaled(vectors: DataFrame, dimension: int, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cells)``: ``floor(scale * x)`` of the vectors with ``dimension`` finite components.

    Others are left out: null vectors, other lengths, null, infinite or undefined components. A component beyond
    ``BITS`` bits stops the job, as distances would not be exact.
    """
    x = F.col("embedding").cast("array<double>")
    whole = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter(
        (F.size("x") == dimension)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    cells = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))))
    small = F.forall("x", lambda v: F.abs(v * F.lit(float(scale))) < F.lit(float(1 << BITS)))
    checked = F.when(small, cells).otherwise(F.raise_error(F.lit(f"a component has over {BITS} bits")))
    return whole.select("vec_id", checked.alias("cells"))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the widest of them needs, behind one byte that tells how many."""
    for kind in (np.int8, np.int16, np.int32):
        limits = np.iinfo(kind)
        if not values.size or limits.min <= values.min() and values.max() <= limits.max:
            return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()
    return b"\x08" + values.astype(np.int64).tobytes()


def _unpacked(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(shape).astype(np.int64)


def shards(cells: DataFrame, dimension: int, width: int = WIDTH, rows: int = CHUNK_ROWS) -> DataFrame:
    """Chunks of at most ``rows`` vectors, cut into blocks of ``width`` columns: one row for each of ``_SHARDS``.

    Vectors are named in the row of block 0. Stored, as each round reads them, block by block:
    a task that reads a block holds nothing of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                own = part.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                names = part.column("vec_id").to_pylist()
                out = [
                    (chunk, block, len(own), _packed(own[:, at : at + width]), None if block else names)
                    for block, at in enumerate(range(0, dimension, width))
                ]
                yield pa.RecordBatch.from_pylist([dict(zip(fields.names, row)) for row in out], fields)
                chunk += 1

    fields = pa.schema([
        ("chunk", pa.int64()), ("block", pa.int32()), ("vectors", pa.int32()), ("cells", pa.binary()),
        ("names", pa.list_(pa.int64())),
    ])
    cut = cells.select("vec_id", "cells").mapInArrow(run, _SHARDS)
    return cut_lineage(cut.repartition("block", "chunk"), "shards")


def first_centroids(cells: DataFrame, many: int) -> np.ndarray:
    """The ``many`` vectors of least sha256 of ``1:<vec_id>``, as rows; equal hashes by components.

    They pass through the driver, ``many`` times ``dimension`` numbers.
    """
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    order = F.sha2(name, 256)
    chosen = cells.select(order.alias("h"), "cells").orderBy("h", "cells").limit(many).collect()
    return np.array([r["cells"] for r in chosen], np.int64)


def _distances(stored: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """``(chunk, distances)``: squared distances of each vector from each centroid within one block of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("chunk", "block", "vectors", "cells"))
            for chunk, block, vectors, cells in zip(*columns):
                own = _unpacked(cells, vectors, -1)
                slices = centroids[:, block * width : (block + 1) * width]
                found = np.empty((vectors, len(slices)), np.int64)
                for i, centroid in enumerate(slices):
                    apart = own - centroid
                    found[:, i] = (apart * apart).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([_packed(found)])], ["chunk", "distances"])

    given = stored.select("chunk", "block", "vectors", "cells")
    return given.mapInArrow(run, "chunk bigint, distances binary")


def assigned(stored: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """``(chunk, clusters, distances)``: nearest centroid of each vector, the smaller number among equals.

    Blocks of a chunk meet by key, are added up and compared; a group is one row for each block of columns.
    """
    many = len(centroids)

    def nearest(group: pa.Table) -> pa.Table:
        total = sum(_unpacked(part, -1, many) for part in group.column("distances").to_pylist())
        cluster = total.argmin(axis=1)
        least = total[np.arange(len(total)), cluster]
        row = [[group.column("chunk")[0].as_py()], [_packed(cluster)], [_packed(least)]]
        return pa.table(row, names=["chunk", "clusters", "distances"])

    parts = _distances(stored, centroids, width)
    return parts.groupBy("chunk").applyInArrow(nearest, "chunk bigint, clusters binary, distances binary")


def moved(stored: DataFrame, found: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The centroids after one round: the floor of the mean of each one's vectors; others stay.

    Each task adds its blocks up by cluster; the driver gets one number for each centroid and column.
    """
    many, dimension = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("block", "vectors", "cells", "clusters"))
            for block, vectors, cells, clusters in zip(*columns):
                own, cluster = _unpacked(cells, vectors, -1), _unpacked(clusters, vectors)
                total, count = sums.setdefault(block, (np.zeros((many, own.shape[1]), np.int64), np.zeros(many, np.int64)))
                np.add.at(total, cluster, own)
                count += np.bincount(cluster, minlength=many)
        out = [
            (block * width + at, cluster, int(total[cluster, at]), int(count[cluster]))
            for block, (total, count) in sums.items()
            for cluster in np.flatnonzero(count).tolist()
            for at in range(total.shape[1])
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["at", "cluster", "total", "many"])

    joined = stored.select("chunk", "block", "vectors", "cells").join(found.select("chunk", "clusters"), "chunk")
    sums = joined.select("block", "vectors", "cells", "clusters").mapInArrow(
        run, "at bigint, cluster bigint, total bigint, many bigint"
    )
    new = centroids.copy()
    for r in sums.groupBy("at", "cluster").agg(F.sum("total").alias("total"), F.sum("many").alias("many")).collect():
        new[r["cluster"], r["at"]] = r["total"] // r["many"]
    return new


def _rows(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``(vec_id, cluster, distance)`` from chunks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, distances = (batch.column(n).to_pylist() for n in ("clusters", "distances"))
            for at, (own, least) in enumerate(zip(clusters, distances)):
                names = batch.column("names")[at].values
                columns = [names, pa.array(_unpacked(own, -1).astype(np.int32)), pa.array(_unpacked(least, -1))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    names = stored.filter("block = 0").select("chunk", "names")
    joined = names.join(found, "chunk").select("names", "clusters", "distances")
    return joined.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame, dimension: int, many: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
    width: int = WIDTH,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of each vector after ``rounds`` of Lloyd, and the centroids, one row each.

    All numbers are whole, so that every sum is exact in any order. Distances come block of columns by
    block: a task needs the slice of the centroids of its block. A round moves, for each vector, one sum for each
    block and centroid, and its columns in as few bytes as they need. Only centroids (``many`` rows of ``dimension``)
    pass through the driver.

    See ``scaled`` for the vectors left out. Fewer vectors than ``many`` give as many centroids; none
    give no rows. Equal ids are vectors of their own; a null id is hashed as no text. Further columns are ignored.
    """
    cells = cut_lineage(scaled(vectors, dimension, scale), "cells")
    centroids = first_centroids(cells, many)
    if not len(centroids):
        return cells.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), centroids
    stored = shards(cells, dimension, width)
    for _ in range(rounds):
        centroids = moved(stored, assigned(stored, centroids, width), centroids, width)
    return cut_lineage(_rows(stored, assigned(stored, centroids, width)), "clusters"), centroids


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the summed distances of each vector's cluster and of all, and the hash of its centroid.

    One row for each cluster meets the vectors.
    """
    hashes: Column = F.array(*[F.lit(centroid_hash(c)) for c in centroids]).cast("array<string>")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own = F.array(*[F.lit(sums.get(i, 0)).cast("bigint") for i in range(len(centroids))]).cast("array<bigint>")
    return found.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"),
        F.get(hashes, F.col("cluster")).alias("centroid_sha256"),
    )
