import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import features as feat
from tallyrack.plans import jobs
from tallyrack.sources import cache
from tallyrack.sources.events import archive
from tests.helpers import rows
from workload import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    p = jobs.Paths(*[str(root / n) for n in ("events", "features", "vectors", "recs")])
    # everything on one day, so that the two jobs have something to work on
    events = tables.with_metadata(tables.events(spark, SF)).drop("value")
    day = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.unix_seconds("ts"), F.lit(86_400)))
    archive(events.withColumn("ts", day), p.events)
    return p


def test_daily_then_incremental(spark, paths):
    out = jobs.daily_full(spark, "2024-01-01", paths, k=10, rank=4)
    assert out["users"] == 15 and out["items"] == 100
    recs = spark.read.parquet(f"{paths.recs}/date=2024-01-01")
    assert out["recommendations"] == recs.count() == 150
    assert recs.agg(F.max("expires_at")).first()[0] == dt.datetime(2024, 1, 3)

    now = dt.datetime(2024, 1, 1, 4)
    done = jobs.incremental_4h(spark, now, paths, "date=2024-01-01", "ts=2024-01-01T04", k=5)
    events = spark.read.parquet(paths.events)
    recent = events.where(F.col("ts") < F.lit(now))
    scored = feat.affected(jobs.strengths(events), recent).select("user_id").distinct()
    assert done["affected_users"] == scored.count()
    merged = spark.read.parquet(f"{paths.recs}/ts=2024-01-01T04")
    by_user = {r.user_id: r.n for r in merged.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    refreshed = {r.user_id for r in scored.collect()}
    assert by_user == {u: (5 if u in refreshed else 10) for u in by_user} and len(by_user) == 15
    both = events.unionByName(recent)
    users = spark.read.parquet(f"{paths.features}/user/ts=2024-01-01T04")
    want = feat.compute_user_features(both)
    assert rows(users, *want.columns) == rows(want)
    items = spark.read.parquet(f"{paths.features}/item/ts=2024-01-01T04")
    assert rows(items) == rows(feat.compute_item_features(both))


def test_a_day_of_four_hourly_runs(spark, paths):
    """Three runs, each on the one before: features of all events read, lists renewed or expired."""
    base = "date=2024-01-01"
    events = spark.read.parquet(paths.events)
    read = events
    for hour in (8, 12, 16):
        now, run = dt.datetime(2024, 1, 1, hour), f"ts=2024-01-01T{hour:02d}"
        done = jobs.incremental_4h(spark, now, paths, base, run, k=3)
        slice_ = events.where((F.col("ts") >= F.lit(now - dt.timedelta(hours=4))) & (F.col("ts") < F.lit(now)))
        read = read.unionByName(slice_)
        changed = {r.user_id for r in spark.read.parquet(f"{paths.vectors}/changed/{run}").collect()}
        assert done["affected_users"] == len(changed) and done["without_vector"] == 0
        users = spark.read.parquet(f"{paths.features}/user/{run}")
        want = feat.compute_user_features(read)
        assert rows(users, *want.columns) == rows(want)
        assert rows(spark.read.parquet(f"{paths.features}/item/{run}")) == rows(feat.compute_item_features(read))
        lists = spark.read.parquet(f"{paths.recs}/{run}")
        assert lists.where(F.col("expires_at") <= F.lit(now)).count() == 0
        assert {r.user_id for r in lists.where("expires_at < '2024-01-02'").collect()} >= changed
        assert spark.read.parquet(f"{paths.vectors}/user/{run}").count() == 15
        stored = spark.read.parquet(paths.lists(run))
        assert rows(cache.from_cache(stored).select("user_id", "rank", "item_id")) == rows(lists.select("user_id", "rank", "item_id"))
        base = run


def test_expired_lists_are_not_carried_on(spark, paths):
    now = dt.datetime(2024, 1, 4)
    jobs.incremental_4h(spark, now, paths, "date=2024-01-01", "ts=2024-01-04T00", k=3)
    assert spark.read.parquet(f"{paths.recs}/ts=2024-01-04T00").count() == 0


def test_blend_is_the_weighted_mean(spark):
    liked = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "y", 2.0), ("c", "none", 1.0)], "user_id string, item_id string, strength double")
    items = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [5.0, 2.0])], "item_id string, embedding array<float>")
    assert {r.user_id: r.embedding for r in jobs.blend_vectors(liked, items).collect()} == {"a": [4.0, 1.5], "b": [5.0, 2.0]}


def test_late_events_arrive_in_the_next_run_once(spark, tmp_path):
    """Files that reach the lake days late, a run without news, and a run that is repeated."""
    p = jobs.Paths(*[str(tmp_path / n) for n in ("events", "features", "vectors", "recs")])
    events = tables.with_metadata(tables.events(spark, SF)).drop("value")
    event = F.col("event_id").cast("bigint")
    parts = {"first": event % 4 != 0, "late": event % 8 == 0, "later": event % 8 == 4}
    first = events.where(parts["first"])
    first = first.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.unix_seconds("ts"), F.lit(86_400))))
    archive(first, p.events)
    jobs.daily_full(spark, "2024-01-01", p, k=3, rank=4)
    jobs.set_cursor(spark, p, "date=2024-01-01")
    base, read = "date=2024-01-01", first
    for day, name in ((4, "late"), (5, None), (6, "later")):
        if name:  # events of the month, among them days before the full run's end
            archive(events.where(parts[name]), p.events)
            read = read.unionByName(events.where(parts[name]))
        run, now = f"ts=2024-01-{day:02d}T04", dt.datetime(2024, 1, day, 4)
        for _ in range(2):  # the second time is a repetition
            jobs.incremental_4h(spark, now, p, base, run, k=3, arrived=True)
        users = spark.read.parquet(f"{p.features}/user/{run}")
        want = feat.compute_user_features(read)
        assert rows(users, *want.columns) == rows(want)
        assert rows(spark.read.parquet(f"{p.features}/item/{run}")) == rows(feat.compute_item_features(read))
        base = run
