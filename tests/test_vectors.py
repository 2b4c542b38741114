"""Nearest items, towers and the ranking network against plain numpy."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tallyrack.operators import candidates as cand
from tallyrack.operators import models, nearest
from tests.helpers import rows


def _vectors(spark, n, dim, seed, name, coarse=False):
    rng = np.random.default_rng(seed)
    data = rng.integers(-1, 2, (n, dim)).astype(float) if coarse else rng.standard_normal((n, dim))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], f"{name} bigint, embedding array<float>")
    return df, data.astype(np.float32).astype(np.float64)


def _brute(u, v, k, exclude=False):
    out = {}
    scores = np.round(u @ v.T, 6)
    for i, row in enumerate(scores):
        best = sorted((-s, j) for j, s in enumerate(row) if not (exclude and i == j))[:k]
        out[i] = [(j, -s) for s, j in best]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.user_id, r["rank"])):
        out.setdefault(r.user_id, []).append((r.item_id, r.score))
    return out


@pytest.mark.parametrize("block_rows,coarse", [(8192, False), (37, False), (10, True)])
def test_exact_equals_brute_force(spark, block_rows, coarse):
    users, u = _vectors(spark, 90, 8, 1, "user_id", coarse)
    items, v = _vectors(spark, 200, 8, 2, "item_id", coarse)
    found = nearest.nearest_items(users, items, 7, digits=6, block_rows=block_rows)
    assert _found(found) == _brute(u, v, 7)


def test_own_vector_is_left_out_and_short_lists_stay_short(spark):
    items, v = _vectors(spark, 5, 4, 3, "item_id")
    users = items.withColumnRenamed("item_id", "user_id")
    assert _found(nearest.nearest_items(users, items, 10, digits=6, exclude_self=True, block_rows=2)) == _brute(v, v, 10, True)


def test_cells_find_everything_when_all_are_probed(spark):
    users, u = _vectors(spark, 60, 8, 4, "user_id")
    items, v = _vectors(spark, 150, 8, 5, "item_id")
    exact = nearest.nearest_items(users, items, 5, digits=6)
    every = nearest.nearest_items(users, items, 5, "cells", cells=6, probes=6, digits=6, block_rows=16)
    assert _found(every) == _found(exact)
    some = nearest.nearest_items(users, items, 5, "cells", cells=6, probes=2, digits=6)
    share = nearest.recall(exact, some).first().recall
    assert 0.2 < share < 1.0
    assert nearest.recall(exact, every).first().recall == 1.0


def test_one_full_cell_is_cut_into_blocks(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    users = spark.range(100).select(F.col("id").alias("user_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    found = nearest.nearest_items(users, items, 3, block_rows=20)
    assert found.count() == 300 and rows(found.select("item_id").distinct()) == [(0,), (1,), (2,)]


def test_empty_sides(spark):
    users, _ = _vectors(spark, 3, 4, 1, "user_id")
    items, _ = _vectors(spark, 3, 4, 1, "item_id")
    assert nearest.nearest_items(users.limit(0), items, 3).count() == 0
    assert nearest.nearest_items(users, items.limit(0), 3).count() == 0


def _norm(x):
    return (x - x.mean()) / np.sqrt(x.var() + 1e-5)


def _mlp(tower, x):
    first, second = tower.layers
    hidden = np.maximum(x @ first.w + first.b, 0)
    return _norm(hidden @ second.w + second.b) * second.gamma + second.beta


def test_user_tower(spark):
    tower = models.new_tower(50, False, seed=1)
    rng = np.random.default_rng(0)
    ids = rng.standard_normal((16, 64)).astype(np.float32)
    hists = [[int(c) for c in rng.integers(0, 50, rng.integers(0, 8))] for _ in range(16)]
    df = spark.createDataFrame([(i, [float(x) for x in ids[i]], hists[i]) for i in range(16)], "user_id int, id_vector array<float>, category_hist array<int>")
    for r in models.embed_users(df, tower).collect():
        padded = hists[r.user_id] + [0] * (5 - len(hists[r.user_id]))
        x = np.concatenate([ids[r.user_id], tower.categories[padded].mean(axis=0)])
        assert len(r.embedding) == 128
        np.testing.assert_allclose(r.embedding, _mlp(tower, x), atol=1e-4)


def test_item_tower(spark):
    tower = models.new_tower(50, True, seed=2)
    ids = np.random.default_rng(1).standard_normal((16, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in ids[i]], i % 50, 10.0 * i) for i in range(16)], "item_id int, id_vector array<float>, category_idx int, price double")
    found = {r.item_id: r.embedding for r in models.embed_items(df, tower).collect()}
    for i in range(16):
        price = np.array([10.0 * i]) @ tower.price.w + tower.price.b
        x = np.concatenate([ids[i], tower.categories[i % 50], price])
        np.testing.assert_allclose(found[i], _mlp(tower, x), atol=1e-4)


def test_towers_with_missing_and_unknown_categories(spark):
    tower, items = models.new_tower(5, False, seed=1), models.new_tower(5, True, seed=2)
    one = [0.5] * 64
    zero = np.zeros_like(tower.categories[0])
    odd = {1: None, 2: 5, 3: -1, 4: 4}
    df = spark.createDataFrame([(i, one, c, 2.0) for i, c in odd.items()], "item_id int, id_vector array<float>, category_idx int, price double")
    for r in models.embed_items(df, items).collect():
        category = items.categories[4] if r.item_id == 4 else zero
        x = np.concatenate([np.array(one), category, np.array([2.0]) @ items.price.w + items.price.b])
        np.testing.assert_allclose(r.embedding, _mlp(items, x), atol=1e-4)
    hists = {1: [None, 2, 99, -7, 1], 2: None, 3: []}
    df = spark.createDataFrame([(i, one, h) for i, h in hists.items()], "user_id int, id_vector array<float>, category_hist array<int>")
    for r in models.embed_users(df, tower).collect():
        rows = [tower.categories[c] if c is not None and 0 <= c < 5 else zero for c in (hists[r.user_id] or [0] * 5)]
        x = np.concatenate([np.array(one), np.mean(rows, axis=0)])
        np.testing.assert_allclose(r.embedding, _mlp(tower, x), atol=1e-4)


@pytest.mark.parametrize("experts,norm,sigmoid,context", [(None, False, True, 32), (4, True, False, 16)])
def test_ranking_network(spark, experts, norm, sigmoid, context):
    dims = (12, 12, context)
    net = models.new_cross_network(dims, 2 if experts is None else 3, (16, 8), experts, norm, sigmoid, seed=5)
    rng = np.random.default_rng(2)
    data = rng.standard_normal((20, sum(dims))).astype(np.float32)
    table = [(i, *[[float(v) for v in part] for part in np.split(row, [12, 24])]) for i, row in enumerate(data)]
    df = spark.createDataFrame(table, "n int, user_vector array<float>, item_vector array<float>, context array<float>")
    for r in models.dcn_score(df, net).collect():
        x0 = data[r.n].astype(np.float64)
        x = x0
        for layer in net.cross:
            if experts:
                gate = np.exp(x @ layer.gate)
                mixed = sum(g * (x @ m) for g, m in zip(gate / gate.sum(), layer.experts))
            else:
                mixed = x @ layer.experts[0]
            x = x0 * mixed + layer.bias + x
        deep = x0
        for layer in net.deep:
            deep = np.maximum(deep @ layer.w + layer.b, 0)
            deep = _norm(deep) * layer.gamma + layer.beta if norm else deep
        want = (np.concatenate([x, deep]) @ net.out.w + net.out.b)[0]
        want = 1 / (1 + np.exp(-want)) if sigmoid else want
        assert r.model_score == pytest.approx(want, abs=1e-6)


def test_scores_keep_rows_and_refuse_wrong_lengths(spark):
    net = models.new_cross_network((2, 2, 1), deep=(4,))
    schema = "n int, user_vector array<float>, item_vector array<float>, context array<float>"
    df = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.0], [0.0]), (2, [1.0], [1.0, 2.0], [0.0]), (3, None, [1.0, 2.0], [0.0])], schema)
    found = {r.n: r.model_score for r in models.dcn_score(df, net).collect()}
    assert found[1] is not None and found[2] is None and found[3] is None
    assert models.dcn_score(df.limit(0), net).count() == 0


def test_missing_vectors_are_zero(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 9), (9, 1)], "user_id bigint, item_id bigint")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "item_id bigint, embedding array<float>")
    users = vectors.withColumnRenamed("item_id", "user_id")
    assert rows(cand.attach_vectors(pairs, users, vectors, 2), "user_id", "item_id", "user_vector", "item_vector") == [
        (1, 1, [1.0, 2.0], [1.0, 2.0]), (1, 9, [1.0, 2.0], [0.0, 0.0]), (9, 1, [0.0, 0.0], [1.0, 2.0]),
    ]
    assert rows(nearest.pair_score(pairs, users, vectors)) == [(1, 1, 5.0), (1, 9, None), (9, 1, None)]


def test_params_round_trip(spark, tmp_path):
    arrays = {"w": np.arange(6.0).reshape(2, 3), "b": np.ones(3)}
    models.save_params(spark, str(tmp_path / "p"), arrays)
    found = models.load_params(spark, str(tmp_path / "p"))
    assert all((found[n] == a).all() for n, a in arrays.items())


def test_learned_vectors_prefer_what_was_liked(spark):
    likes = [(f"u{u}", f"i{i}", 3.0) for u in range(12) for i in range(12) if u % 2 == i % 2 and (u + i) % 5]
    users, items = models.learn_vectors(spark.createDataFrame(likes, "user_id string, item_id string, strength double"), rank=4)
    best = nearest.nearest_items(users, items, 4).collect()
    same = [int(r.user_id[1:]) % 2 == int(r.item_id[1:]) % 2 for r in best]
    assert len(best) == 48 and sum(same) > 40


def test_loss(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 0.0), (-50.0, 0.0)], "logit double, label double")
    want = np.mean([np.log(2), 2 + np.log1p(np.exp(-2)), 0.0])
    assert models.bce(df).first().loss == pytest.approx(want)


def test_category_candidates_prefer_then_fill(spark):
    catalog = spark.createDataFrame([(f"i{i:02d}", f"c{i % 4}") for i in range(20)], "item_id string, category_id string")
    users = spark.createDataFrame([("u", ["c1", "c1", "c2"]), ("none", []), ("odd", ["zzz"])], "user_id string, category_prefs array<string>")
    found = {}
    for r in sorted(cand.category_candidates(users, catalog, k=12, seed=3).collect(), key=lambda r: r["rank"]):
        found.setdefault(r.user_id, []).append((r.item_id, r.score))
    assert [len(v) for v in found.values()] == [12, 12, 12]
    picked = [i for i, _ in found["u"]]
    assert len(set(picked)) == 12 and all(int(i[1:]) % 4 in (1, 2) for i in picked[:10])
    assert found["u"][0][1] == 1.0 and found["u"][-1][1] == pytest.approx(1 / 12)


def test_category_pages_are_bounded(spark):
    catalog = spark.createDataFrame([(f"i{i:03d}", "big" if i < 90 else "small") for i in range(100)], "item_id string, category_id string")
    pages = cand.category_index(catalog, page_rows=20).collect()
    assert all(len(p["items"]) <= 20 for p in pages)
    big = [i for p in sorted(pages, key=lambda p: p.page) if p.category_id == "big" for i in p["items"]]
    assert big == [f"i{i:03d}" for i in range(90)]


def test_blocks_hold_few_scores_and_lose_none():
    """2,000 users by 20,000 items in one block: rounded scores with many ties, own rows left out."""
    rng = np.random.default_rng(3)
    users, items = rng.integers(-3, 4, (2000, 4)) / 4, rng.integers(-3, 4, (20_000, 4)) / 4

    def table(name, vectors):
        return pa.table({name: np.arange(len(vectors)), "vector": pa.array(list(vectors))})

    left, right = table("user_id", users), table("item_id", items)
    tracemalloc.start()
    found = nearest._best_in_block(left, right, 10, 1, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # 16 million scores at once alone are twice that
    for user in range(0, 2000, 97):
        scores = np.round(users[user] @ items.T, 1) + 0.0
        scores[user] = -np.inf
        want = np.lexsort((np.arange(len(items)), -scores))[:10]
        got = found.filter(pc.equal(found["user_id"], user))
        assert got["item_id"].to_pylist() == want.tolist() and got["score"].to_pylist() == scores[want].tolist()


def test_scores_that_are_no_numbers_rank_nowhere_in_any_chunk():
    items = np.ones((9000, 1))
    items[[0, 5000]], items[[1, 8000]], items[[2, 8999]] = np.nan, np.inf, -np.inf
    rows, cols, values = nearest._best_of(np.ones((1, 1)), items, 3, 6, None, np.array([-np.inf]))
    assert cols.tolist() == [1, 8000, 3] and values.tolist() == [np.inf, np.inf, 1.0]


def test_small_blocks_grow_rather_than_multiply(spark):
    """A block emits k rows per user: with k = 1 they count the blocks that each user was sent to."""
    def side(name):
        return spark.createDataFrame([(i, [float(i)], 1) for i in range(64)], f"{name} bigint, vector array<double>, cell int")

    assert nearest._best_per_cell(side("user_id"), side("item_id"), 1, 1, None, False).count() <= 64 * 16


def test_scores_closer_than_single_precision_rank_right():
    """Single precision only leaves out; what it can't tell apart is decided in double precision."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    for factor in (1.0, 1e-30, 1e25, 1e150):
        items = (base + rng.normal(size=(3000, 16)) * 1e-9) * factor
        users = rng.normal(size=(5, 16)) * factor
        rows, cols, values = nearest._best_of(users, items, 6, None, None, np.full(5, -np.inf))
        for user in range(5):
            scores = np.einsum("j,ij->i", users[user], items)
            want = np.lexsort((np.arange(3000), -scores))[:6]
            assert np.allclose(values[rows == user], scores[want], rtol=1e-14, atol=0)
            assert set(cols[rows == user]) <= set(np.flatnonzero(scores >= scores[want[-1]] - 1e-14 * abs(scores[want[-1]])))


def test_equal_scores_stay_few_and_in_order():
    """All items alike: ties go by place, whatever order the parts come in."""
    best = nearest._Best(np.ones((3, 2)), np.ones((4000, 2)), 3, 6, np.array([0, 5, -1]), np.array([-np.inf, 2.0, 2.1]))
    places = np.arange(4000, dtype=np.int32)
    best.add(2000, 4000, places)
    best.add(0, 2000, places)
    rows, cols, values = best.found()
    assert rows.tolist() == [0, 0, 0, 1, 1, 1] and cols.tolist() == [1, 2, 3, 0, 1, 2] and set(values) == {2.0}


def test_a_middling_table_is_cut_for_several_cores(spark):
    """20,000 by 20,000 rows were one block, so one task did all the work; short vectors are put in larger blocks."""
    def side(name):
        return spark.range(20_000).selectExpr(f"id AS {name}", "array(double(id)) AS vector", "1 AS cell")

    parts = nearest._best_per_cell(side("user_id"), side("item_id"), 1, nearest.BLOCK_ROWS, None, False)
    assert parts.count() == 20_000 * 3  # three blocks of items at least 8,192 rows large
    assert [nearest._item_block(10**7, dim, nearest.BLOCK_ROWS) for dim in (6, 32, 64, 500)] == [262_144, 131_072, 65_536, 65_536]
