"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet.llm.common import sent_if_few
from parapet.session import cut_lineage

NEAREST = 20
#: Dimensions of the projection; even, so that the chi-square probability has a closed form.
PROJECTED = 8
#: Probability with which a neighbour has to lie within the projected radius searched.
CERTAINTY = 0.99
LEAF = 512
#: Vectors in one index shard, and queries in one block.
SHARD_ROWS = 1 << 13
QUERY_ROWS = 1 << 13
#: Queries of a block that are searched side by side.
TOGETHER = 512


def chi_square_quantile(probability: float, degrees: int) -> float:
    """The value below which a chi-square variable of an even number of degrees stays."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= middle / 2 / i
            total += term
        low, high = (middle, high) if 1 - math.exp(-middle / 2) * total < probability else (low, middle)
    return high


def projection(dimension: int, projected: int = PROJECTED) -> np.ndarray:
    """A matrix of standard normal (2-stable) numbers, the same for each call."""
    seed = int.from_bytes(hashlib.blake2b(f"{dimension} {projected}".encode(), digest_size=8).digest(), "big")
    return np.random.default_rng(seed).standard_normal((dimension, projected))


class Tree:
    """A kd-tree over projected points: leaves in order, with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            axis = int(np.ptp(points[own], axis=0).argmax())
            order = own[np.argsort(points[own, axis], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([points[own].min(axis=0) for own in self.leaves])
        self.high = np.array([points[own].max(axis=0) for own in self.leaves])

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of leaf boxes, one row for each of ``points``."""
        found = np.zeros((len(points), len(self.leaves)))
        for axis in range(points.shape[1]):
            own = points[:, axis, None]
            apart = np.maximum(np.maximum(self.low[:, axis] - own, own - self.high[:, axis]), 0)
            found += apart * apart
        return found


def inner(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision; each depends on its two rows alone."""
    return (rows * others).sum(axis=1)


class Index:
    """One shard: vectors, their projections and a tree over these.

    The largest inner product is the least distance once each vector gets one more component that
    brings it to length ``longest`` (0 for queries): ``|q - x|^2 = |q|^2 + longest^2 - 2 q.x``.
    """

    def __init__(self, names: np.ndarray, vectors: np.ndarray, longest: float, projected: int = PROJECTED):
        self.names, self.vectors, self.longest = names, vectors, longest
        rest = np.sqrt(np.maximum(longest**2 - (vectors * vectors).sum(axis=1), 0))
        self.matrix = projection(vectors.shape[1] + 1, projected)
        self.points = vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]
        self.tree = Tree(self.points)

    def search(self, names: np.ndarray, queries: np.ndarray, many: int, certainty: float = CERTAINTY):
        """``(query, name, score)``: the ``many`` best found for each query but its own name, best first.

        Each query takes leaves by growing projected distance and verifies their vectors by inner product. The
        squared projected distance over the squared distance is chi-square distributed; so a query ends
        where the former exceeds the quantile times the squared distance of the worst of its ``many``
        best. Queries that take the same leaf in the same round are worked on together.
        """
        limit = chi_square_quantile(certainty, self.points.shape[1])
        points = queries @ self.matrix[:-1]
        whole = (queries * queries).sum(axis=1) + self.longest**2
        slack = 1e-9 * (1 + whole)  # more than matrix products may be off; exact values decide
        bounds = self.tree.bounds(points)
        order = np.argsort(bounds, axis=1, kind="stable")
        own = np.arange(len(queries))
        worst, radius = np.full(len(queries), -np.inf), np.full(len(queries), np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for turn in range(order.shape[1]):
            leaf = order[:, turn]
            active = own[bounds[own, leaf[own]] <= radius[own]]
            own, parts = active, [best]
            for number in np.unique(leaf[active]):
                asked, members = active[leaf[active] == number], self.tree.leaves[number]
                apart = (points[asked] ** 2).sum(axis=1)[:, None] - 2 * points[asked] @ self.points[members].T
                apart += (self.points[members] ** 2).sum(axis=1)
                close = apart <= (radius + slack)[asked, None]
                near = queries[asked] @ self.vectors[members].T >= (worst - slack)[asked, None]
                i, j = np.nonzero(close & near & (self.names[members] != names[asked, None]))
                found = asked[i], members[j]
                parts.append((found[0], self.names[found[1]], inner(self.vectors[found[1]], queries[found[0]])))
            which, found, scores = (np.concatenate(x) for x in zip(*parts))
            by = np.lexsort((found, -scores, which))
            which, found, scores = which[by], found[by], scores[by]
            starts = np.searchsorted(which, which)
            kept = np.arange(len(which)) - starts < many
            which, found, scores = best = which[kept], found[kept], scores[kept]
            last = np.flatnonzero(np.arange(len(which)) - np.searchsorted(which, which) == many - 1)
            worst[which[last]] = scores[last]
            radius[which[last]] = limit * np.maximum(whole[which[last]] - 2 * scores[last], 0.0)
            if not len(own):
                break
        return names[which] if len(which) else which, found, scores


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _once(rows: pd.DataFrame, name: str, vector: str, one: bool) -> pd.DataFrame:
    """Rows without repeats of name and vector; with ``one``, just the least vector of each name."""
    if not rows[name].duplicated().any():
        return rows
    rows = rows.assign(_key=rows[vector].map(tuple)).sort_values([name, "_key"])
    return rows.drop_duplicates([name] if one else [name, "_key"])


def search(
    vectors: DataFrame, queries: Column, many: int = NEAREST, shard_rows: int = SHARD_ROWS,
    certainty: float = CERTAINTY,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``many`` largest inner products found.

    ``vectors`` holds ``(vec_id, embedding)``; ``queries`` says which rows are queries. Vectors are dealt by a hash of
    their id into shards of about ``shard_rows``; each shard meets all queries in blocks, and the best of its part
    are merged. Hence equal vectors never gather in one task, whatever their share. Components are read as doubles.

    Vectors that are null, zero, or hold null or non-finite components take no part. A query is compared with vectors of
    its own length only. Its own row is left out, by id (null ids take no part); other rows of equal vectors are
    found, and ties go to the smaller id. Repeated rows count once; different vectors of one id are candidates each, and the
    least of them, component by component, asks for that id; fewer than ``many`` candidates give all;
    an empty table gives no rows; further columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = cut_lineage(rows.withColumn("square", square), "vectors")
    # One row for each length of vectors there is.
    shape = rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max("square").alias("top")
    )
    shape = shape.select(
        "dim", F.sqrt("top").alias("longest"), F.ceil(F.col("n") / shard_rows).alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.col("q") / QUERY_ROWS)).alias("blocks"),
    )
    known = rows.join(sent_if_few(cut_lineage(shape, "shape"), 10_000), "dim")
    points = known.withColumns({
        "shard": F.pmod(F.xxhash64("vec_id"), "shards"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
    })
    asked = known.filter("asks").withColumns({
        "block": F.pmod(F.xxhash64(F.lit(1), "vec_id"), "blocks"),
        "shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1)),
    })
    key = ["dim", "shard", "block"]

    def run(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(wanted):
            own, wanted = _once(own, "p_vec_id", "p_v", False), _once(wanted, "vec_id", "v", True)
            index = Index(own["p_vec_id"].to_numpy(), np.stack(own["p_v"].to_list()), own["p_longest"].iloc[0])
            asked, names = np.stack(wanted["v"].to_list()), wanted["vec_id"].to_numpy()
            for at in range(0, len(names), TOGETHER):
                part = slice(at, at + TOGETHER)
                out.append(np.rec.fromarrays(index.search(names[part], asked[part], many, certainty)))
        found = np.concatenate(out) if out else np.zeros(0, [("f0", "i8"), ("f1", "i8"), ("f2", "f8")])
        return pd.DataFrame({"query_id": found["f0"], "vec_id": found["f1"], "score": found["f2"]})

    # Both sides come from one table: names of its own keep their columns apart.
    columns = [*key, "vec_id", "v", "longest"]
    points = points.select(columns).toDF(*[f"p_{c}" for c in columns])
    found = points.groupBy(*[f"p_{c}" for c in key]).cogroup(asked.select(columns).groupBy(*key)).applyInPandas(
        run, "query_id bigint, vec_id bigint, score double"
    )
    # Spark keeps the best of each task before it shuffles.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= many)
    return ranked.select("query_id", "rank", "vec_id", "score")
