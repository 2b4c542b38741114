import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrack.llm import nearest


def brute(ids, points, asked, k=5):
    out = []
    for q in sorted(set(asked)):
        i = ids.index(q)
        rest = sorted((-float(points[i] @ points[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        out += [(q, r + 1, v, int(-s)) for r, (s, v) in enumerate(rest)]
    return out


def table(spark, ids, points):
    rows = [(int(i), [float(x) for x in p]) for i, p in zip(ids, points)]
    return spark.createDataFrame(rows, "vec_id bigint, v array<double>").withColumn("score", F.lit("clash")).withColumn("shard", F.lit(7)).repartition(3)


def run(spark, ids, points, every=5):
    df = table(spark, ids, points)
    return sorted(map(tuple, nearest.top_k(df, df.filter(f"vec_id % {every} = 0")).collect()))


@pytest.mark.parametrize("spread", [2, 40])
def test_against_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(nearest, "SHARD", 100)
    monkeypatch.setattr(nearest, "QUERIES", 20)
    monkeypatch.setattr(nearest, "PILOT", 30)
    rng = np.random.default_rng(spread)
    points = np.floor(rng.normal(size=(600, 6)) * spread)  # a small spread gives many ties
    points[200:330] = points[0]
    ids = rng.permutation(600).tolist()
    assert run(spark, ids, points) == brute(ids, points, [i for i in ids if i % 5 == 0])


def test_tree_bounds_and_pruning():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8)) * 200
    points = np.floor(np.repeat(centers, 100, axis=0) + rng.normal(size=(2000, 8)) * 5)
    tree = nearest.KDTree(np.arange(2000), points, 16)
    query = points[5]
    bounds = tree.bounds(query[None])[0]
    for node, bound in zip(tree.nodes, bounds):
        if node.rows is not None:
            assert (points[node.rows] @ query).max() <= bound + 1e-6
    leaves = sum(n.rows is not None for n in tree.nodes)
    seen = 0

    class Counted(np.ndarray):
        pass

    real = tree.points
    tree.points = real.view(Counted)
    got = tree.search(query, 5, 5, -np.inf, bounds)
    want = sorted(((float(real[j] @ query), -j) for j in range(2000) if j != 5), reverse=True)[:5]
    assert sorted(((s, -i) for s, i in got), reverse=True) == want
    assert leaves > 60 and seen == 0


def test_odd_rows(spark):
    vectors = [
        (0, [0.5, -0.1]), (1, None), (2, [0.25, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (50, [1.0, 1.0]),
        (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (150, []), (7, [-0.001, 0.0]),
    ]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").filter(nearest.usable(F.col("embedding")))
    assert {r["vec_id"] for r in df.collect()} == {0, 5, 50, None, 100, 150, 7}
    v = df.select("vec_id", nearest.quantized(F.col("embedding")).alias("v"))
    assert {r["vec_id"]: r["v"] for r in v.collect()}[7] == [-1.0, 0.0]
    got = sorted(map(tuple, nearest.top_k(v, v.filter("vec_id % 50 = 0")).collect()))
    assert got == brute([0, 5, 7, 50], np.floor(256 * np.array([[0.5, np.float32(-0.1)], [0.5, 0.5], [-0.001, 0.0], [1.0, 1.0]])), [0, 50])
    assert nearest.top_k(v.limit(0), v).count() == 0 and nearest.top_k(v, v.limit(0)).count() == 0
    one = v.filter("vec_id = 50")
    assert nearest.top_k(one, one).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    df = table(spark, *zip(*rows))
    got = sorted(map(tuple, nearest.top_k(df, df.filter("vec_id = 0")).collect()))
    assert got == [(0, 1, 1, 2), (0, 2, 1, 2), (0, 3, 2, 1)]


def test_a_query_that_repeats_takes_no_neighbour_away():
    ids = np.array([7] * 4 + list(range(20, 32)))
    points = np.array([[9.0, 9.0]] * 4 + [[float(i % 6), 1.0] for i in range(12)])
    tree, query = nearest.KDTree(ids, points), points[0]
    best = sorted(((-float(p @ query), int(i)) for i, p in zip(ids, points) if i != 7))[:5]
    found = tree.search(query, 7, 5, -np.inf, tree.bounds(query[None, :])[0])
    assert sorted((-s, i) for s, i in found) == best
