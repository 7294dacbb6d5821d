"""Clustering against plain whole-number Lloyd."""

import hashlib
import math
import random

import pytest

from parapet.llm import lloyd

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, dimension, many=16, rounds=3):
    import numpy as np

    kept = []
    for name, x in rows:
        if x is not None and len(x) == dimension and all(v is not None and math.isfinite(v) for v in x):
            kept.append((name, [math.floor(64 * float(np.float32(v))) for v in x]))
    text = lambda name: "" if name is None else str(name)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{text(r[0])}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:many]]
    for turn in range(rounds + 1):
        found = []
        for _, x in kept:
            distances = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            found.append((distances.index(min(distances)), min(distances)))
        if turn < rounds:
            for i in range(len(centroids)):
                own = [x for (_, x), (c, _) in zip(kept, found) if c == i]
                if own:
                    centroids[i] = [sum(column) // len(own) for column in zip(*own)]
    of = {i: sum(d for c, d in found if c == i) for i in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(n, c, d, of[c], sum(of.values()), digest[c]) for (n, _), (c, d) in zip(kept, found)]
    return sorted(rows, key=repr)


def result(df, dimension, **options):
    return sorted((tuple(r) for r in lloyd.report(*lloyd.cluster(df, dimension, **options)).collect()), key=repr)


def vectors(seed, many, dimension, spread=2.0):
    pick = random.Random(seed)
    rows = [(i, [pick.uniform(-spread, spread) for _ in range(dimension)]) for i in range(many)]
    rows += [(5, rows[5 % many][1]), (None, rows[7 % many][1]), (6, rows[9 % many][1])]  # repeated, unnamed, one id twice
    bad = [None, [], [0.5] * (dimension - 1), [0.5] * (dimension + 1), [None] + [0.5] * (dimension - 1)]
    bad += [[float("nan")] + [0.5] * (dimension - 1), [float("inf")] + [0.5] * (dimension - 1)]
    return rows + [(1000 + i, x) for i, x in enumerate(bad)]


@pytest.mark.parametrize("dimension, width", [(64, 16), (10, 4), (3, 5)])
def test_equals_plain_rounds(spark, dimension, width):
    rows = vectors(dimension, 120, dimension)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df, dimension, width=width) == plain(rows, dimension)


def test_ties_empty_clusters_and_large_numbers(spark):
    pick = random.Random(1)
    rows = [(i, [float(pick.choice([-1000, 0, 1000]))] * 4) for i in range(60)]  # equal centroids: all but the first stay empty
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, 4, width=1) == plain(rows, 4)
    with pytest.raises(Exception, match="27 bits"):
        result(spark.createDataFrame([(1, [3e6] * 4)], SCHEMA), 4)


def test_many_copies_of_one_vector(spark):
    rows = vectors(3, 30, 8) + [(77, [0.25] * 8)] * 500
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(7), 8) == plain(rows, 8)


def test_chunks(spark):
    """Chunks far smaller than a batch, so that blocks of many chunks meet."""
    rows = vectors(4, 90, 6)
    cells = lloyd.scaled(spark.createDataFrame(rows, SCHEMA).repartition(2), 6)
    stored = lloyd.shards(cells, 6, width=2, rows=7)
    counts = stored.groupBy("block").sum("vectors").collect()
    assert {r[0]: r[1] for r in counts} == {0: 93, 1: 93, 2: 93}
    centroids = lloyd.first_centroids(cells, 5)
    found = lloyd._rows(stored, lloyd.assigned(stored, centroids, 2)).collect()
    for r in found:
        own = [x for n, x in rows if n == r["vec_id"] and x and len(x) == 6]
        distances = [min(sum((math.floor(64 * v) - c) ** 2 for v, c in zip(x, cs)) for cs in centroids.tolist()) for x in own]
        assert r["distance"] in distances


def test_few_none_and_extra_columns(spark):
    rows = vectors(5, 4, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 as cells", "2 as chunk", "3 as `a.b`", "4 as cluster")
    assert result(more, 3) == plain(rows, 3)
    assert result(spark.createDataFrame([(1, None)], SCHEMA), 3) == []
    assert result(spark.createDataFrame([], SCHEMA), 3) == []
