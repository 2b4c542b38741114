"""Inner-product search with bounds against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrack.operators import bounded, nearest
from tests.helpers import rows

SCHEMA = "{} bigint, embedding array<double>"


def _frame(spark, name, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], SCHEMA.format(name))


def _best(users, items, k, exclude_self=False):
    """Best items by plain loops; only equal lengths meet, scores that are no numbers rank nowhere."""
    out = set()
    for u, a in users:
        scored = []
        for i, b in items:
            if a is None or b is None or len(a) != len(b) or (exclude_self and u == i) or None in [*a, *b]:
                continue
            with np.errstate(invalid="ignore"):
                s = float(np.dot(np.array(a, float), np.array(b, float)))
            if not np.isnan(s) and s > -np.inf:
                scored.append((-(round(s, 6) + 0.0), i))
        out |= {(u, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def _of(df):
    return {(r.user_id, r["rank"], r.item_id, r.score) for r in df.collect()}


def _grouped(n, seed, groups=12, dim=6):
    """Integer vectors around some centres, of very different lengths and with many ties."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).integers(-20, 21, (groups, dim))
    picked = centres[rng.integers(0, groups, n)] + rng.integers(-1, 2, (n, dim))
    return [(i, [int(x) for x in v * rng.choice([1, 1, 1, 3])]) for i, v in enumerate(picked)]


@pytest.mark.parametrize("k,cells,block_rows", [(1, None, 65_536), (7, 20, 11), (7, 1, 64), (400, 10, 64)])
def test_sure_bounds_lose_nothing(spark, k, cells, block_rows):
    users, items = _grouped(60, 1), _grouped(300, 2)
    done = bounded.search(_frame(spark, "user_id", users), _frame(spark, "item_id", items), k, cells, digits=6, block_rows=block_rows)
    assert _of(done.found) == _best(users, items, k)


def test_cells_are_left_out_and_a_spread_leaves_out_more(spark):
    users, items = _grouped(80, 3), _grouped(600, 4)
    u, i = _frame(spark, "user_id", users), _frame(spark, "item_id", items)
    exact = nearest.nearest_items(u, i, 5, digits=6)
    sure, likely = (bounded.search(u, i, 5, 40, spread, digits=6) for spread in (None, 1.0))
    shares = [bounded.share_scored(d, u, i).first() for d in (sure, likely)]
    assert shares[0].pairs == 80 * 600 and 0 < shares[1].scored <= shares[0].scored < 0.5 * shares[0].pairs
    assert nearest.recall(exact, sure.found).first().recall == 1.0
    assert nearest.recall(exact, likely.found).first().recall > 0.5


def test_own_row_does_not_count(spark):
    items = _grouped(120, 5)
    frame = _frame(spark, "item_id", items)
    found = nearest.nearest_items(frame.withColumnRenamed("item_id", "user_id"), frame, 4, "bounded", exclude_self=True, digits=6)
    assert _of(found) == _best(items, items, 4, True)


def test_odd_vectors(spark):
    """Nulls, NaN, infinities, zeros, other lengths and empty vectors each have their defined result."""
    inf, nan = float("inf"), float("nan")
    odd = [(1000, None), (1001, [1, None, 0, 0, 0, 0]), (1002, [nan] * 6), (1003, [inf, 1, 1, 1, 1, 1]), (1004, [0] * 6),
           (1005, [2, 3]), (1006, [-5, 1]), (1007, []), (1008, [-inf, 1, 1, 1, 1, 1])]
    users, items = _grouped(20, 6) + odd, _grouped(90, 7) + odd
    found = nearest.nearest_items(_frame(spark, "user_id", users), _frame(spark, "item_id", items), 6, "bounded", digits=6)
    got, want = _of(found), _best(users, items, 6)
    assert got == want
    assert not [r for r in got if r[0] in (1000, 1001, 1002)] and [r for r in got if r[0] == 1005] != []


def test_repeated_rows_and_extra_columns(spark):
    items = _grouped(50, 8)
    frame = _frame(spark, "item_id", items).withColumn("cell", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("length", F.lit(1))
    users = _frame(spark, "user_id", items[:5] * 2).withColumn("floor", F.lit("y")).withColumn("cells", F.lit(0))
    exact, found = (nearest.nearest_items(users, frame, 3, m, digits=6) for m in ("exact", "bounded"))
    assert rows(found) == rows(exact)


def test_empty_sides(spark):
    users, items = _frame(spark, "user_id", _grouped(3, 1)), _frame(spark, "item_id", _grouped(3, 1))
    assert nearest.nearest_items(users.limit(0), items, 3, "bounded").count() == 0
    assert nearest.nearest_items(users, items.limit(0), 3, "bounded").count() == 0
    with pytest.raises(ValueError):
        nearest.nearest_items(users, items, 3, "bounded", cells=5000)


def test_centres_from_a_sample_still_place_every_item(spark, monkeypatch):
    monkeypatch.setattr(bounded, "FIT_ROWS", 40)
    users, items = _grouped(30, 9), _grouped(400, 10)
    found = nearest.nearest_items(_frame(spark, "user_id", users), _frame(spark, "item_id", items), 5, "bounded", digits=6)
    assert _of(found) == _best(users, items, 5)


def test_users_are_sent_once_per_group_of_cells(spark, monkeypatch):
    vectors = list(enumerate(np.random.default_rng(5).integers(-9, 10, (400, 16)).tolist()))  # hardly a cell can be left out
    users, items = _frame(spark, "user_id", vectors), _frame(spark, "item_id", vectors)
    sent = []

    def counted(users, *rest):
        sent.append(users.count())
        return nearest._best_per_cell(users, *rest)

    monkeypatch.setattr(bounded, "_best_per_cell", counted)
    done = bounded.search(users, items, 5, cells=40, block_rows=100)
    assert done.probed.count() > 20 * 400
    assert sum(sent) <= 2 * 8 * 400  # two passes; at most 8 groups hold 100 rows or one cell each
    assert _of(done.found) == _best(vectors, vectors, 5)


def test_groups_hold_a_block_and_every_cell():
    rows = np.array([5, 0, 900, 30, 30, 30, 30, 1])
    group = bounded._groups(np.random.default_rng(1).normal(size=(8, 3)), rows, 100)
    sums = np.bincount(group, rows)
    assert len(group) == 8 and sums.sum() == rows.sum()
    assert all(total <= 100 or (group == g).sum() == 1 for g, total in enumerate(sums))


def test_items_of_a_group_are_not_cut_again(spark, monkeypatch):
    """With vectors without common directions each user meets each group: once, not once per part of it."""
    vectors = list(enumerate(np.random.default_rng(6).integers(-9, 10, (400, 16)).tolist()))
    users, items = _frame(spark, "user_id", vectors), _frame(spark, "item_id", vectors)
    emitted = []

    def counted(*given):
        emitted.append(nearest._best_per_cell(*given).count())
        return nearest._best_per_cell(*given)

    monkeypatch.setattr(bounded, "_best_per_cell", counted)
    done = bounded.search(users, items, 1, cells=40, block_rows=10)  # a row for each user and block it was sent to, at most
    assert sum(emitted) <= 400 * 10
    assert _of(done.found) == _best(vectors, vectors, 1)


def test_cells_asked_for_are_sent_as_bits(spark):
    cells = bounded._Cells(*(np.arange(20) for _ in range(6)), np.arange(20)[::-1], np.array([0, 3, 20]))
    users = _frame(spark, "user_id", [(1, [1.0]), (2, [2.0])])

    def choose(x, floor):
        flags = np.zeros((len(x), 20), bool)
        flags[:, 19], flags[x[:, 0] == 2, 0] = True, True  # the first of the first group, the last of the other
        return flags

    sent = bounded._sent(users.withColumnRenamed("embedding", "vector"), cells, choose).collect()
    got = {(r.user_id, r.cell): bytes(r.cells) for r in sent}
    assert got == {(1, 0): b"\x01", (2, 0): b"\x01", (2, 1): b"\x00\x00\x01"}


def test_users_without_length_get_their_lists(spark):
    """All cells promise the same, so both passes must take the same one for the first."""
    items = _grouped(300, 11)
    users = [(i, [0] * 6) for i in range(3)]
    found = nearest.nearest_items(_frame(spark, "user_id", users), _frame(spark, "item_id", items), 250, "bounded", digits=6, block_rows=20)
    assert _of(found) == _best(users, items, 250)
