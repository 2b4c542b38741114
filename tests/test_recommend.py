"""The request cascade: one request per case."""

import json

import pytest
from pyspark.sql import functions as F

from tallyrack.plans import recommend as rec
from tests.helpers import at, rows

REQUESTS = "request_id string, user_id string, session_id string, limit string, load_ratio double"
RECS = "user_id string, rank int, item_id string, score double"


@pytest.fixture(scope="module")
def base(spark):
    recs = [("user1", i + 1, f"item{i + 1}", 0.9 - 0.1 * i) for i in range(3)]
    recs += [("many", i + 1, f"m{i:03d}", 1.0 - i / 1000) for i in range(100)]
    recs += [("sold", 1, "item2", 0.9), ("tie", 1, "t1", 0.5), ("tie", 2, "t2", 0.5)]
    return {
        "recs": spark.createDataFrame(recs, RECS),
        "popular": spark.createDataFrame([(1, "pop1", 100.0), (2, "pop2", 90.0)], "rank int, item_id string, score double"),
        "stock": spark.createDataFrame([("item2", "2", True), ("pop9", "9", True)], "item_id string, bit_offset string, out_of_stock boolean"),
        "session_events": spark.createDataFrame(
            [("1", "sess", at(0), "click", "item1"), ("2", "sess", at(1), "view", "item1"), ("3", "sess", at(2), "click", "pop1")],
            "event_id string, session_id string, ts timestamp, event_type string, item_id string",
        ),
    }


def plus(df):
    return df.withColumn("model_score", F.col("score") + 0.1)


def broken(df):
    return df.withColumn("model_score", F.lit(None).cast("double"))


def answer(spark, base, *requests, ranker=None, **change):
    named = [(f"r{i}", *r) for i, r in enumerate(requests)]
    parts = {**base, **change}
    out = rec.recommend(spark.createDataFrame(named, REQUESTS), ranker=ranker, **parts)
    found = {r.request_id: (r.tier, [i.item_id for i in r["items"]], [round(i.score, 6) for i in r["items"]]) for r in out.collect()}
    return [found[f"r{i}"] for i in range(len(requests))]


def test_cached_lists(spark, base):
    found = answer(
        spark, base,
        ("user1", "", None, None),
        ("user1", "", "1", None),
        ("many", None, "10", None),
        ("many", "", "1000", None),
        ("sold", "", None, None),
    )
    assert found[0] == ("tier1_precomputed", ["item1", "item3"], [0.9, 0.7])  # item2 is out of stock
    assert found[1] == ("tier1_precomputed", ["item1"], [0.9])
    assert found[2][1] == [f"m{i:03d}" for i in range(10)]
    assert len(found[3][1]) == 100
    assert found[4] == ("tier1_precomputed", [], [])  # a hit whose items are all sold out


def test_misses_fall_back_to_popular(spark, base):
    found = answer(spark, base, ("new", "", None, 0.5), ("new", "", "1", 0.5), ("new", "sess", None, 0.5))
    assert found[0] == ("fallback_popular", ["pop1", "pop2"], [100.0, 90.0])
    assert found[1] == ("fallback_popular", ["pop1"], [100.0])
    # re-ranked, yet still a fallback
    assert found[2] == ("fallback_popular", ["pop1", "pop2"], [99.5, 90.0])


def test_popular_is_cut_before_the_stock_filter(spark, base):
    gone = spark.createDataFrame([("pop1", "1", True)], "item_id string, bit_offset string, out_of_stock boolean")
    found = answer(spark, base, ("new", "", "1", None), ("new", "", "2", None), ("new", "", "1", 3.0), stock=gone)
    assert found[0] == ("fallback_popular", [], [])
    assert found[1] == ("fallback_popular", ["pop2"], [90.0])
    assert found[2] == ("fallback_popular", ["pop1"], [100.0])  # an emergency skips the stock filter


def test_sessions_rerank_hits(spark, base):
    found = answer(
        spark, base,
        ("user1", "sess", None, None),
        ("user1", "unknown", None, None),
        ("tie", "sess", None, None),
        ("user1", "sess", None, 2.0),
        ("user1", "sess", None, 1.5),
        ("user1", "sess", None, 3.0),
    )
    assert found[0] == ("tier2_rerank", ["item3", "item1"], [0.7, 0.2])  # clicked and viewed: -0.7
    assert found[1] == ("tier2_rerank", ["item1", "item3"], [0.9, 0.7])
    assert found[2] == ("tier2_rerank", ["t1", "t2"], [0.5, 0.5])
    assert found[3] == ("tier1_precomputed", ["item1", "item3"], [0.9, 0.7])  # critical
    assert found[4][0] == "tier2_rerank"  # warning
    assert found[5] == ("fallback_popular", ["pop1", "pop2"], [100.0, 90.0])  # emergency


def test_no_session_store_means_no_rerank(spark, base):
    assert answer(spark, base, ("user1", "sess", None, None), session_events=None) == [
        ("tier1_precomputed", ["item1", "item3"], [0.9, 0.7])
    ]


def test_the_model_ranks_misses_only(spark, base):
    found = answer(
        spark, base,
        ("new", "", None, None),
        ("new", "sess", None, None),
        ("new", "", None, 1.5),
        ("user1", "", None, None),
        ("new", "", None, 3.0),
        ranker=plus,
    )
    assert found[0] == ("tier3_inference", ["pop1", "pop2"], [100.1, 90.1])
    assert found[1] == ("tier3_inference", ["pop1", "pop2"], [99.6, 90.1])
    assert found[2] == ("fallback_popular", ["pop1", "pop2"], [100.0, 90.0])  # warning
    assert found[3][0] == "tier1_precomputed"
    assert found[4][0] == "fallback_popular"


def test_a_failing_model_keeps_the_popular_list(spark, base):
    assert answer(spark, base, ("new", "", None, None), ranker=broken) == [
        ("fallback_popular", ["pop1", "pop2"], [100.0, 90.0])
    ]


def test_model_order_and_empty_lists(spark, base):
    def upside_down(df):
        return df.withColumn("model_score", -F.col("score"))

    def flat(df):
        return df.withColumn("model_score", F.lit(0.5))

    assert answer(spark, base, ("new", "", None, None), ranker=upside_down)[0][1] == ["pop2", "pop1"]
    assert answer(spark, base, ("new", "", None, None), ranker=flat)[0][1] == ["pop1", "pop2"]
    nothing = base["popular"].limit(0)
    assert answer(spark, base, ("new", "", None, None), ranker=flat, popular=nothing) == [("tier3_inference", [], [])]
    assert answer(spark, base, ("new", "", None, None), ("x", "", None, 3.0), popular=nothing) == [("fallback_popular", [], [])] * 2


def test_hot_users_and_missing_sessions_give_the_same_answers(spark, base):
    requests = [("user1", "sess" if i % 2 else None, None, None) for i in range(40)] + [("new", None, None, None)] * 5
    assert answer(spark, base, *requests, hot_rows=3) == answer(spark, base, *requests)


def test_responses(spark, base):
    requests = spark.createDataFrame([("r0", "user1", "", None, None), ("r1", "sold", "", None, None)], REQUESTS)
    answers = rec.recommend(requests, **base)
    arms = spark.createDataFrame([("exp-full", "v7", 100.0)], "experiment_id string, model_version string, traffic_pct double")
    bodies = {r.request_id: json.loads(r.body) for r in rec.responses(answers, arms).collect()}
    assert bodies["r0"]["tier"] == "tier1_precomputed" and bodies["r0"]["experiment_id"] == "exp-full"
    assert bodies["r1"]["items"] == []
    plain = json.loads(rec.responses(answers).where("request_id = 'r0'").first().body)
    assert set(plain) == {"items", "tier"}
    assert rows(rec.recommendation_rows(answers), "request_id", "rank", "item_id") == [("r0", 1, "item1"), ("r0", 2, "item3")]


def test_popular_responses(spark, base):
    requests = spark.createDataFrame([("a", "1"), ("b", None), ("c", "x")], "request_id string, limit string")
    found = {r.request_id: (r.tier, len(r["items"])) for r in rec.popular_responses(requests, base["popular"]).collect()}
    assert found == {"a": ("tier0_popular", 1), "b": ("tier0_popular", 2), "c": ("tier0_popular", 2)}
    empty = rec.popular_responses(requests, base["popular"].limit(0)).collect()
    assert [len(r["items"]) for r in empty] == [0, 0, 0]


def test_a_model_over_whole_lists(spark, base):
    users = spark.createDataFrame([("new", [1.0, 0.0]), ("odd", None)], "user_id string, embedding array<float>")
    items = spark.createDataFrame([("pop1", [1.0, 9.0]), ("pop2", [3.0, 9.0]), ("other", [9.0, 9.0])], "item_id string, embedding array<float>")

    def ranker(score):
        return rec.ListRanker(users, items, 2, score)

    dots = ranker(lambda u, v: (u * v).sum(axis=1))
    asked = [("new", "", None, None), ("nobody", "", None, None), ("odd", "", None, None), ("user1", "", None, None), ("new", "", None, 3.0), ("new", "", "1", None)]
    found = answer(spark, base, *asked, ranker=dots)
    assert found[0] == ("tier3_inference", ["pop2", "pop1"], [3.0, 1.0])
    assert found[1] == found[2] == ("tier3_inference", ["pop1", "pop2"], [0.0, 0.0])  # no vector: ties keep their order
    assert found[3] == ("tier1_precomputed", ["item1", "item3"], [0.9, 0.7])
    assert found[4][0] == "fallback_popular" and found[5] == ("tier3_inference", ["pop1"], [1.0])
    failing = ranker(lambda u, v: (u * v).sum(axis=1) * float("nan"))
    assert answer(spark, base, asked[0], ranker=failing) == [("fallback_popular", ["pop1", "pop2"], [100.0, 90.0])]
    assert answer(spark, base, asked[0], ranker=dots, popular=base["popular"].limit(0)) == [("tier3_inference", [], [])]


def test_no_candidate_becomes_a_row(spark, base):
    users = spark.createDataFrame([("new", [1.0])], "user_id string, embedding array<float>")
    ranker = rec.ListRanker(users, users.withColumnRenamed("user_id", "item_id"), 1, lambda u, v: u[:, 0])
    requests = spark.createDataFrame([("r0", "new", "", None, None)], REQUESTS)
    plan = rec.recommend(requests, ranker=ranker, **base)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("MapInArrow") == 1


def test_lists_and_sessions_end(spark, base):
    ends = base["recs"].withColumn("expires_at", F.lit(at(100)))
    asked = ("user1", "sess", None, None)

    def tier(seconds):
        return answer(spark, {**base, "recs": ends}, asked, as_of=F.lit(at(seconds)))[0]

    assert tier(50) == answer(spark, base, asked)[0]
    assert tier(100) == ("fallback_popular", ["pop1", "pop2"], [99.5, 90.0])
    assert tier(4000)[2] == [100.0, 90.0]  # the session has ended and penalises nothing


def test_a_list_ranker_gets_bounded_matrices(spark, base):
    """5,000 misses of 100 candidates: no call of the model may see all candidates of a task."""
    popular = spark.createDataFrame([(i + 1, f"pop{i}", 200.0 - i) for i in range(100)], "rank int, item_id string, score double")
    users = spark.createDataFrame([("new", [1.0])], "user_id string, embedding array<double>")
    items = spark.createDataFrame([("pop7", [5.0])], "item_id string, embedding array<double>")

    def score(u, v):
        return (u * v).sum(axis=1) * (1.0 if len(u) <= 32_768 else float("nan"))

    ranker = rec.ListRanker(users, items, 1, score)
    requests = spark.createDataFrame([(f"r{i}", "new", "", "100", None) for i in range(5000)], REQUESTS)
    found = rec.recommend(requests, base["recs"], popular, base["stock"], ranker=ranker)
    first = found.select("tier", F.col("items")[0]["item_id"].alias("best"))
    assert rows(first.distinct()) == [("tier3_inference", "pop7")]
