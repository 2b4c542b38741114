from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyrack.functions import hashing, keys, rules, vectors
from tests.helpers import rows


def fnv(text: str) -> int:
    h = 2166136261
    for byte in text.encode():
        h = ((h ^ byte) * 16777619) % 2**32
    return h


def java_hash(text: str) -> int:
    units = text.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (31 * h + units[i] * 256 + units[i + 1]) % 2**32
    return h & 0x7FFFFFFF


words = st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words)
def test_hashes_equal_the_definition(spark, texts):
    df = spark.createDataFrame([(t,) for t in [*texts, "", "user-123", "é", "😀"]], "t string")
    found = df.select("t", hashing.fnv1a_32(F.col("t")), hashing.java_hash_31(F.col("t"))).collect()
    assert all(r[1] == fnv(r[0]) and r[2] == java_hash(r[0]) for r in found)


def test_limits(spark):
    asked = [("10",), (None,), ("",), ("abc",), ("0",), ("-5",), ("+7",), ("500",), (" 7",), ("99999999999999999999",), ("100",)]
    df = spark.createDataFrame(asked, "l string").select(rules.effective_limit(F.col("l")))
    assert [r[0] for r in df.collect()] == [10, 20, 20, 20, 20, 20, 7, 100, 20, 20, 100]


def test_load_levels_and_tiers(spark):
    df = spark.createDataFrame([(0.0,), (1.49,), (1.5,), (1.99,), (2.0,), (2.99,), (3.0,), (None,)], "r double")
    leveled = df.select(rules.load_level(F.col("r")).alias("level"))
    assert [r[0] for r in leveled.collect()] == [
        "normal", "normal", "warning", "warning", "critical", "critical", "emergency", "normal",
    ]
    allowed = {
        r["level"]: (r["a"], r["b"], r["c"], r["d"])
        for r in leveled.distinct()
        .select(
            "level",
            rules.tier_allowed(F.col("level"), "tier1").alias("a"),
            rules.tier_allowed(F.col("level"), "tier2").alias("b"),
            rules.tier_allowed(F.col("level"), F.lit("tier3")).alias("c"),
            rules.tier_allowed(F.col("level"), "other").alias("d"),
        )
        .collect()
    }
    assert allowed == {
        "normal": (True, True, True, True),
        "warning": (True, True, False, True),
        "critical": (True, False, False, True),
        "emergency": (False, False, False, True),
    }


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [1, 2])], "a array<float>, b array<float>, h array<int>")
    row = df.select(
        vectors.dot(F.col("a"), F.col("b")), vectors.pad(F.col("h"), 4), vectors.pad(F.col("h"), 1), vectors.zeros(2)
    ).first()
    assert tuple(row) == (32.0, [1, 2, 0, 0], [1, 2], [0.0, 0.0])


def test_batched_dot_equals_dot(spark):
    data = [([float(i), 2.0, 3.0], [4.0, float(i), 6.0]) for i in range(50)]
    data += [([1.0], [5.0]), (None, [1.0]), ([1.0], None), ([1.0, 2.0], [1.0])]
    df = spark.createDataFrame(data, "a array<float>, b array<float>")
    found = df.select(vectors.dot(F.col("a"), F.col("b")).alias("x"), vectors.dot_batch("a", "b").alias("y")).collect()
    assert all(r.x == r.y for r in found)
    assert [r.y for r in found[50:]] == [5.0, None, None, None]


def test_keys(spark):
    c = F.lit("x1")
    built = [
        keys.rec_top_k(c), keys.rec_ttl(c), keys.user_clicks_1h(c), keys.user_views_1d(c), keys.user_recent_items(c),
        keys.item_ctr_7d(c), keys.item_popularity(c), keys.stock_bitmap(), keys.stock_id_map(c), keys.session_events(c),
        keys.experiment_config(c), keys.experiment_active(),
    ]
    assert list(spark.range(1).select(*built).first()) == [
        "rec:x1:top_k", "rec:x1:ttl", "feat:user:x1:clicks_1h", "feat:user:x1:views_1d", "feat:user:x1:recent_items",
        "feat:item:x1:ctr_7d", "feat:item:x1:popularity", "stock:bitmap", "stock:id_map:x1", "session:x1:events",
        "experiment:x1", "experiment:active",
    ]


def test_scores_take_both_penalties(spark):
    df = spark.createDataFrame([(0.9, True, True), (0.9, True, False), (0.9, False, True), (0.9, False, None)], "s double, c boolean, v boolean")
    found = df.select(F.round(rules.adjusted_score(F.col("s"), F.col("c"), F.col("v")), 6))
    assert rows(found) == [(0.2,), (0.4,), (0.7,), (0.9,)]
