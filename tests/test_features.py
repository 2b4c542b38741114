import pytest
from pyspark.sql import functions as F

from tallyrack.operators import features as feat
from tallyrack.operators import ranking
from tallyrack.operators.candidates import category_candidates
from tallyrack.plans import jobs
from tests.helpers import at, rows

EVENTS = [
    ("ann", "lamp", "view", "light"),
    ("ann", "lamp", "view", "light"),
    ("ann", "desk", "add_to_cart", "wood"),
    ("bob", "lamp", "click", "light"),
    ("bob", "chair", "purchase", None),
    ("bob", "chair", "click", None),
    ("eve", "vase", "click", "glass"),
    ("eve", "vase", "click", "glass"),
    ("eve", "desk", "view", "wood"),
    ("dan", "rug", "search", "wool"),
]
SCHEMA = "user_id string, item_id string, event_type string, category_id string"


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(EVENTS, SCHEMA)


def test_user_features(events):
    found = {r.user_id: tuple(r)[1:] for r in feat.compute_user_features(events).collect()}
    # clicks, views, purchases, categories, events
    assert found == {
        "ann": (0, 2, 0, ["light", "wood"], 3),
        "bob": (2, 0, 1, ["light"], 3),
        "eve": (2, 1, 0, ["glass", "wood"], 3),
        "dan": (0, 0, 0, ["wool"], 1),
    }


def test_user_features_fold_by_hashing_first(events):
    plan = feat.compute_user_features(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ObjectHashAggregate") < plan.index(" HashAggregate") and "SortAggregate" not in plan


def test_item_features(events):
    found = {r.item_id: (r.click_count, r.purchase_count, r.ctr, r.unique_users) for r in feat.compute_item_features(events).collect()}
    assert found == {
        "lamp": (1, 0, 0.5, 2),
        "desk": (0, 0, 0.0, 2),
        "chair": (1, 1, 1.0, 1),
        "vase": (2, 0, 2.0, 1),  # clicks and no views: the denominator is 1
        "rug": (0, 0, 0.0, 1),
    }


def test_counts_of_unknown_pairs_are_zero(spark, events):
    pairs = spark.createDataFrame([("bob", "click"), ("bob", "search"), ("nobody", "view")], "user_id string, event_type string")
    assert rows(feat.event_count_of(feat.event_counts(events), pairs)) == [
        ("bob", "click", 2),
        ("bob", "search", 0),
        ("nobody", "view", 0),
    ]


def test_merge_equals_full(spark, events):
    first, second = spark.createDataFrame(EVENTS[:4], SCHEMA), spark.createDataFrame(EVENTS[4:] + EVENTS[:2], SCHEMA)
    both = first.unionByName(second)
    merged = feat.merge_user_features(feat.compute_user_features(first), feat.compute_user_features(second))
    assert rows(merged) == rows(feat.compute_user_features(both), *merged.columns)
    counts = feat.merge_item_counts(feat.item_user_counts(first), feat.item_user_counts(second))
    assert rows(feat.item_features_from_counts(counts)) == rows(feat.compute_item_features(both))
    sketched = feat.item_features_from_sketches(
        feat.merge_item_sketches(feat.item_sketches(first), feat.item_sketches(second))
    )
    assert rows(sketched) == rows(feat.compute_item_features(both))


def test_merge_recs_new_rows_win(spark):
    schema = "user_id string, rank int, item_id string, score double"
    old = spark.createDataFrame([("a", 1, "x", 0.9), ("a", 2, "y", 0.8), ("b", 1, "x", 0.7)], schema)
    new = spark.createDataFrame([("a", 1, "z", 0.5), ("c", 1, "w", 0.4)], schema)
    assert rows(feat.merge_recs(old, new)) == [("a", 1, "z", 0.5), ("b", 1, "x", 0.7), ("c", 1, "w", 0.4)]


def test_popular_items_are_ranked_by_events(spark, events):
    timed = events.crossJoin(spark.createDataFrame([(at(0),)], "ts timestamp"))
    top = [(r["rank"], r["item_id"], r["score"]) for r in ranking.popular_items(timed, 2).collect()]
    assert top == [(1, "chair", 7.0), (2, "desk", 4.0)]


def test_strength_of_counts_is_the_strength_of_events(events):
    counted = feat.item_user_counts(events).select("user_id", "item_id", feat.strength_of_counts().alias("strength")).where("strength > 0")
    assert rows(counted) == rows(jobs.strengths(events))
    assert ("ann", "desk", 3.0) in rows(counted)  # a cart alone counts


def test_candidates_of_users_without_preferences(spark):
    users = spark.createDataFrame([("a", ["x"]), ("b", None), ("c", []), ("d", [None]), ("e", ["x", None, "y"])], "user_id string, category_prefs array<string>")
    items = [("x", 1), ("y", 2), ("x", 3), ("y", 3), ("z", 4), ("z", 5)]  # item 3 stands in two categories
    catalog = spark.createDataFrame(items, "category_id string, item_id int")
    found = {}
    for r in category_candidates(users, catalog, k=4, order=F.col("item_id")).orderBy("user_id", "rank").collect():
        found.setdefault(r.user_id, []).append(r.item_id)
    assert found == {"a": [1, 3, 2, 4], "b": [1, 2, 3, 4], "c": [1, 2, 3, 4], "d": [1, 2, 3, 4], "e": [1, 2, 3, 4]}


def test_top_k_breaks_ties_by_item(spark):
    scores = spark.createDataFrame([("u", "b", 1.0), ("u", "a", 1.0), ("u", "c", 2.0)], "user_id string, item_id string, score double")
    assert rows(ranking.top_k(scores, 2)) == [("u", 1, "c", 2.0), ("u", 2, "a", 1.0)]


def test_top_k_is_trimmed_before_the_shuffle(spark):
    scores = spark.createDataFrame([("u", "b", 1.0)], "user_id string, item_id string, score double")
    plan = ranking.top_k(scores, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
