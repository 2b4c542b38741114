import datetime as dt
import json

from pyspark.sql import functions as F

from tallyrack import schemas
from tallyrack.functions.jsonio import event_json
from tallyrack.operators import ingest
from tallyrack.sources import cache, events as lake, streams
from tests.helpers import at, rows

GOOD = {"event_type": "click", "user_id": "u1", "item_id": "i1"}
FULL = ("evt-001", "user-123", "click", "item-456", "cat-789", at(0), "sess-abc", ("shoes", 3, 29900, "search"))
BARE = ("evt-002", "user-123", "view", "item-456", "", at(0.25), "", ("", 0, 0, ""))


def test_first_failing_rule_wins(spark):
    bodies = [
        json.dumps(GOOD),
        json.dumps({**GOOD, "event_type": "like", "user_id": ""}),
        json.dumps({**GOOD, "user_id": ""}),
        json.dumps({"event_type": "click", "item_id": "i1"}),
        json.dumps({**GOOD, "item_id": ""}),
        "{not json",
        json.dumps({**GOOD, "metadata": {"position": "third"}}),
        None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, value string")
    valid, rejected = ingest.validate_events(df)
    assert [r.n for r in valid.collect()] == [0]
    assert rows(rejected, "n", "reject_reason") == [
        (1, "invalid event_type"),
        (2, "user_id is required"),
        (3, "user_id is required"),
        (4, "item_id is required"),
        (5, "invalid JSON"),
        (6, "invalid JSON"),
        (7, "invalid JSON"),
    ]


def test_every_event_type_is_accepted(spark):
    kinds = ["click", "view", "purchase", "search", "add_to_cart", "remove_from_cart"]
    df = spark.createDataFrame([(json.dumps({**GOOD, "event_type": k}),) for k in kinds], "value string")
    assert ingest.validate_events(df)[0].count() == 6


def test_event_round_trip(spark):
    df = spark.createDataFrame([FULL, BARE], schemas.EVENT)
    bodies = {json.loads(r[0])["event_id"]: json.loads(r[0]) for r in df.select(event_json()).collect()}
    assert bodies["evt-001"]["metadata"] == {"query": "shoes", "position": 3, "price": 29900, "source": "search"}
    assert bodies["evt-002"]["metadata"] == {} and bodies["evt-002"]["category_id"] == ""
    parsed = ingest.parse_events(streams.to_topic(df))
    assert rows(parsed.where(~F.col("parse_error")), *df.columns) == rows(df)


def test_times_and_unknown_fields(spark):
    body = {"event_id": "e", "user_id": "u", "event_type": "view", "item_id": "i", "extra": {"a": 1}}
    times = ["2026-03-18T12:00:00Z", "2026-03-18T14:00:00+02:00", 1773835200000, "soon"]
    df = spark.createDataFrame([(json.dumps({**body, "timestamp": t}),) for t in times], "value string")
    found = ingest.parse_events(df).select("ts", "parse_error", "metadata").collect()
    assert [r.ts for r in found] == [at(0)] * 3 + [None]
    assert [r.parse_error for r in found] == [False] * 3 + [True]
    assert tuple(found[0].metadata) == ("", 0, 0, "")


def test_a_message_is_decoded_once_below_the_filters(spark):
    df = spark.createDataFrame([("{}",)], "value string").withColumn("raw", F.col("value"))
    for parse in (ingest.parse_events, ingest.parse_inventory):
        parsed = parse(df)
        for kept in (parsed.where(~F.col("parse_error")).drop("raw"), parsed.where(F.col("parse_error")).select("raw")):
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert plan.count("from_json") == 1 and plan.count("RLIKE") <= 2


def test_null_and_broken_messages_keep_their_row(spark):
    texts = [None, "", "null", "[]", "{broken", '{"user_id": 1}', '{"item_id": "i", "timestamp": "2026-03-18T12:00:00Z"}']
    df = spark.createDataFrame([(v,) for v in texts], "value string").withColumn("raw", F.col("value"))
    assert [r.parse_error for r in ingest.parse_events(df).collect()] == [True] * 7
    found = ingest.parse_inventory(df).collect()
    assert [(r.raw, r.parse_error) for r in found] == [(v, i < 6) for i, v in enumerate(texts)]


def test_replayed_batches_get_the_same_ids(spark):
    df = spark.createDataFrame([("u1", "i1"), ("u2", "i1")], "user_id string, item_id string")
    once, again = (ingest.enrich_events(df, F.lit(at(0)), ["user_id", "item_id"]) for _ in range(2))
    assert rows(once) == rows(again) and once.select("event_id").distinct().count() == 2
    assert ingest.enrich_events(df).select("event_id").distinct().count() == 2


def test_dims_report_the_first_failure(spark):
    df = spark.createDataFrame(
        [(1, [0.0] * 4, [0.0] * 4, [0.0] * 2), (2, [0.0] * 3, [0.0] * 4, [0.0]), (3, [0.0] * 4, None, [0.0] * 2)],
        "n int, user array<float>, item array<float>, context array<float>",
    )
    valid, rejected = ingest.check_dims(df, {"user": 4, "item": 4, "context": 2})
    assert [r.n for r in valid.collect()] == [1]
    assert rows(rejected, "n", "reject_reason") == [
        (2, "user: expected dim 4, got 3"),
        (3, "item: expected dim 4, got 0"),
    ]


def test_lake_reads_prune_and_overwrites_are_partial(spark, tmp_path):
    path = str(tmp_path / "lake")
    days = [at(0), at(86_400), at(90_000)]
    df = spark.createDataFrame([(f"e{i}", *FULL[1:5], t, *FULL[6:]) for i, t in enumerate(days)], schemas.EVENT)
    lake.archive(df, path)
    assert [r.event_id for r in lake.read_day(spark, path, days[0].date()).collect()] == ["e0"]
    found = lake.read_slice(spark, path, at(90_001), 4)
    assert rows(found, "event_id") == [("e1",), ("e2",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(ts" in plan
    counted = lake.write_counted(
        lake.with_date(df.where("event_id = 'e0'").withColumn("user_id", F.lit("new"))), path, ["date"]
    )
    assert counted == {"rows": 1}
    assert rows(spark.read.parquet(path), "event_id", "user_id") == [
        ("e0", "new"), ("e1", "user-123"), ("e2", "user-123"),
    ]


def test_cache_round_trip_and_expiry(spark):
    recs = spark.createDataFrame(
        [("u1", 2, "b", 0.8), ("u1", 1, "a", 0.9), ("u2", 1, "c", 0.7)],
        "user_id string, rank int, item_id string, score double",
    )
    cached = cache.to_cache(recs, 60, F.lit(at(0)))
    stored = {r.key: r for r in cached.collect()}
    assert json.loads(stored["rec:u1:top_k"].value) == [{"item_id": "a", "score": 0.9}, {"item_id": "b", "score": 0.8}]
    assert stored["rec:u1:top_k"].expires_at == at(60)
    assert rows(cache.from_cache(cached, F.lit(at(59)))) == rows(recs)
    assert cache.from_cache(cached, F.lit(at(60))).count() == 0
    assert cache.to_cache(recs.limit(0), 60, F.lit(at(0))).count() == 0
    popular = spark.createDataFrame([(i, f"p{i}", 1.0 / i) for i in range(1, 6)], "rank int, item_id string, score double")
    assert rows(cache.popular_from_cache(cache.popular_to_cache(popular), 3), "rank") == [(1,), (2,), (3,)]


def test_compaction_drops_expired_rows(spark, tmp_path):
    df = spark.createDataFrame([("a", at(10)), ("b", at(-10)), ("c", None)], "key string, expires_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    cache.compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), F.lit(at(0)))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "key") == [("a",), ("c",)]


def test_requests_need_a_user(spark):
    df = spark.createDataFrame([("r1", "u"), ("r2", ""), ("r3", None)], "request_id string, user_id string")
    valid, rejected = ingest.validate_requests(df)
    assert rows(valid, "request_id") == [("r1",)] and rows(rejected, "request_id") == [("r2",), ("r3",)]


def test_dates_are_utc(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 3, 18, 23, 59, 59),)], "ts timestamp")
    assert lake.with_date(df).first().date == dt.date(2026, 3, 18)
