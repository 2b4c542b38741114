"""As-of joins, running sums and the measures of ranked lists against plain Python."""

import random

from pyspark.sql import functions as F

from tallyrack.operators import evaluate, models, ranking
from tallyrack.operators.asof import asof_join, running_sums
from tests.helpers import at, rows

LEFT = "id bigint, k string, ts timestamp, a string"
RIGHT = "k string, ts timestamp, v bigint, w string"


def _tables(seed, n=150):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", "c", None])
    when = lambda: None if rng.random() < 0.05 else at(rng.randrange(60) * 7)
    left = [(i, key(), when(), rng.choice("xyz")) for i in range(n)]
    right = [(key(), when(), rng.randrange(1000), rng.choice(["p", "q", None])) for _ in range(n // 3)]
    return left, right


def _brute(left, right, strict):
    out = []
    for i, k, ts, a in left:
        seen = [r for r in right if None not in (k, ts, r[0], r[1]) and r[0] == k and (r[1] < ts if strict else r[1] <= ts)]
        best = max(seen, key=lambda r: (r[1], r[2], r[3] is not None, r[3] or ""), default=(None,) * 4)
        out.append((i, k, ts, a, best[2], best[3]))
    return sorted(out, key=repr)


def test_asof_join_as_by_brute_force(spark):
    for seed, strict, width in ((1, True, 60), (2, False, 60), (3, True, 7), (4, False, 100_000)):
        left, right = _tables(seed)
        ours = spark.createDataFrame(left, LEFT).withColumn("v", F.lit("replaced"))
        found = asof_join(ours, spark.createDataFrame(right, RIGHT), "k", ["v", "w"], strict=strict, width_seconds=width)
        assert rows(found, "id", "k", "ts", "a", "v", "w") == _brute(left, right, strict)


def test_asof_join_of_empty_sides(spark):
    left, right = _tables(5)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert asof_join(a.limit(0), b, "k", ["v"]).count() == 0
    alone = asof_join(a, b.limit(0), "k", ["v"])
    assert alone.count() == len(left) and alone.where("v is not null").count() == 0


def test_running_sums_carry_over_buckets(spark):
    _, right = _tables(6, 600)
    found = running_sums(spark.createDataFrame(right, RIGHT), "k", {"n": F.count("*"), "total": F.sum("v")}, width_seconds=30)
    good = [r for r in right if r[0] is not None and r[1] is not None]
    want = {(k, ts): (sum(r[0] == k and r[1] <= ts for r in good), sum(r[2] for r in good if r[0] == k and r[1] <= ts)) for k, ts, *_ in good}
    assert {(r.k, r.ts): (r.n, r.total) for r in found.collect()} == want


def test_features_do_not_see_the_event_or_later_ones(spark):
    events = [("1", "u", "i", "view", at(0)), ("2", "u", "i", "click", at(10)), ("3", "u", "i", "click", at(90_000)), ("4", None, "i", "view", at(90_001)), ("5", "u", "i", "signup", at(5))]
    df = spark.createDataFrame(events, "event_id string, user_id string, item_id string, event_type string, ts timestamp")
    found = models.training_set_as_of(df)
    assert rows(found, "event_id", "label", "total_clicks", "total_views", "click_count", "ctr") == [
        ("1", 0.0, 0, 0, 0, 0.0), ("2", 1.0, 0, 1, 0, 0.0), ("3", 1.0, 1, 1, 1, 1.0), ("4", 0.0, 0, 0, 2, 2.0),
    ]


def test_no_task_sorts_a_whole_key(spark, capsys):
    left, right = _tables(7)
    asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "k", ["v"]).explain()
    windows = [line for line in capsys.readouterr().out.splitlines() if "Window [" in line]
    # one over the rows, in buckets, and one over a row per bucket
    assert len(windows) == 2 and sum("_bucket" in line.split("[_key")[1].split("]")[0] for line in windows) == 1


def test_ranking_measure_by_hand(spark):
    lists = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x"), ("d", 1, "x")], "user_id string, rank int, item_id string")
    held = spark.createDataFrame([("a", "y"), ("a", "q"), ("b", "z"), ("c", "x"), ("c", "x")], "user_id string, item_id string")
    row = evaluate.ranking_measure(lists, held, 2).first()
    gain = 1 / 1.584962500721156
    assert (row.users, row.hits) == (3, 1)
    assert abs(row.recall - 0.5 / 3) < 1e-12 and abs(row.ndcg - gain / (1 + gain) / 3) < 1e-12
    popular = spark.createDataFrame([(1, "x"), (2, "y")], "rank int, item_id string")
    assert evaluate.popular_measure(popular, held, 2).first().hits == 2
    assert evaluate.ranking_measure(lists, held.limit(0), 2).first().recall is None


def test_learned_vectors_beat_popularity_on_held_out_events(spark):
    """Two groups of users with their own items: factors tell them apart, one popular list can't."""
    rng = random.Random(8)
    events = []
    for user in range(60):
        for j in range(12):
            item = rng.randrange(20) + 20 * (user % 2)
            events.append((f"e{user:02d}-{j:02d}", f"u{user:02d}", f"i{item:02d}", "click", at(100 * j + user)))
    df = spark.createDataFrame(events, "event_id string, user_id string, item_id string, event_type string, ts timestamp")
    rest, held = evaluate.leave_last_out(df)
    assert rest.count() == len(events) - 60 and held.count() == 60
    strengths = rest.groupBy("user_id", "item_id").agg(F.count("*").cast("double").alias("strength"))
    users, items = models.learn_vectors(strengths, rank=4, iterations=8)
    scores = users.withColumnRenamed("embedding", "u").join(items.withColumnRenamed("embedding", "v"), F.lit(True)).select(
        "user_id", "item_id", F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score")
    )
    learned = evaluate.ranking_measure(ranking.top_k(scores, 20), held, 20).first()
    popular = evaluate.popular_measure(ranking.popular_items(rest, 20), held, 20).first()
    assert learned.recall > 0.9 > 0.7 > popular.recall and learned.ndcg > popular.ndcg
