import numpy as np
import pytest
from pyspark.sql import functions as F

from parapet.llm import neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, vectors, names=None):
    names = range(len(vectors)) if names is None else names
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in zip(names, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def exact(vectors, names, many=20):
    data = np.asarray(vectors, np.float32).astype(float)
    out = {}
    for i, name in enumerate(names):
        if name % 20 == 0:
            scores = (data * data[i]).sum(axis=1)
            order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-scores[j], names[j]))
            out[name] = [(names[j], scores[j]) for j in order[:many]]
    return out


def run(df, **options):
    out = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["round", "clustered", "lengths"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 32))
    if kind == "clustered":
        vectors = vectors[:30].repeat(50, axis=0) + 0.3 * vectors
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if kind == "lengths":
        vectors *= rng.exponential(size=1500)[:, None]
    found, wanted = run(table(spark, vectors), shard_rows=400), exact(vectors, range(1500))
    assert set(found) == set(wanted)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.95 * 20 * len(wanted)
    assert all(len(own) == 20 for own in found.values())
    exact_score = np.asarray(vectors, np.float32).astype(float)
    for q, own in found.items():
        for i, score in own:
            assert score == pytest.approx(exact_score[q] @ exact_score[i], abs=1e-12)


def test_few_rows_ties_and_unusable(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [1, 0], [1, 0], [0, 0], None, [nan, 1], [inf, 1], [None, 1], [0.5, 0], [3, 4, 5], [], [2, 0], [2, 0]]
    names = [20, 7, 3, 1, 2, 4, 5, 6, 40, 60, 80, 9, 9]
    found = run(table(spark, vectors, names))
    assert found == {20: [(9, 2.0), (3, 1.0), (7, 1.0), (40, 0.5)], 40: [(9, 1.0), (3, 0.5), (7, 0.5), (20, 0.5)]}


def test_different_vectors_of_one_id(spark):
    """Each is a candidate, in any order of rows; the least of them asks."""
    vectors = [[1, 0], [0, 1], [3, 3], [2, 1], [2, 1], [0, 2], [5, 0], [1, 0]]
    names = [20, 20, 4, 4, 4, 7, 40, 20]
    wanted = {20: [(4, 3.0), (7, 2.0), (4, 1.0), (40, 0.0)], 40: [(4, 15.0), (4, 10.0), (20, 5.0), (7, 0.0), (20, 0.0)]}
    for order in (1, -1):
        assert run(table(spark, vectors[::order], names[::order])) == wanted


def test_a_hot_vector(spark):
    vectors = [[1.0, 2.0, 3.0]] * 800 + [[3.0, 2.0, 1.0]] * 100
    found = run(table(spark, vectors), shard_rows=200)
    assert [i for i, _ in found[0]] == list(range(1, 21))
    assert [i for i, _ in found[820]] == list(range(800, 820))


def test_empty_table(spark):
    assert neighbours.search(table(spark, []), F.lit(True)).collect() == []


def test_quantile():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert neighbours.chi_square_quantile(0.99, 2) == pytest.approx(9.2103, abs=1e-3)
