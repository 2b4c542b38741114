"""Streams with keyed state against plain versions, over several micro-batches and restarts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrack.operators import sessions
from tallyrack.streaming import job, stateful
from tests.helpers import rows
from tests.test_streaming import EVENT, START, brute, feed, run, stream

SESSION_EVENT = "event_id string, session_id string, event_type string, item_id string, ts timestamp"
EPOCH = dt.datetime(1970, 1, 1)


def second(ts):
    return (ts - EPOCH).total_seconds()


def test_runs_of_equal_sums():
    rng = random.Random(1)
    for _ in range(500):
        panes = np.array(sorted(rng.sample(range(100, 160), rng.randint(1, 20))))
        sums = np.array([[rng.randint(0, 3), 1] for _ in panes])
        width, since = rng.randint(1, 30), rng.randint(90, 170)
        until = since + rng.randint(1, 80)
        got = {}
        for first, last, total in zip(*stateful.runs_of(panes, sums, width, since, until)):
            for e in range(first, last + 1):
                assert e not in got
                got[e] = tuple(total)
        want = {}
        for e in range(since + 1, until + 1):
            held = (panes >= e - width) & (panes < e)
            if held.any():
                want[e] = tuple(sums[held].sum(axis=0))
        assert got == want


def batches(seed, n=5):
    """Micro-batches of events, some of them minutes or hours late."""
    rng, out, now = random.Random(seed), [], 0
    for b in range(n):
        some = []
        for i in range(rng.randint(1, 25)):
            late = rng.choice([0, 0, 0, 30, 600, 4000, 9000])
            ts = START + dt.timedelta(seconds=max(0, now + rng.randint(0, 900) - late), microseconds=rng.choice([0, 1, 999_999]))
            some.append((f"{b}-{i}", rng.choice(["ann", "bob", "only-views"]), rng.choice(["click", "view"]), ts))
        out.append([(i, u, "view" if u == "only-views" else k, t) for i, u, k, t in some])
        now += rng.choice([300, 1200, 5000])
    return out + [[("end", "zoe", "view", START + dt.timedelta(hours=12))]]


def simulated(parts, panes_first, size=3600, slide=60):
    """Windows closed at the end; an event counts in the windows that its batch's watermark has not closed.

    An aggregation before the state takes what the watermark of the batch before has not closed.
    """
    counts, mark, seen, before = {}, -1e18, -1e18, -1e18
    for b, part in enumerate(parts):
        for _, user, kind, ts in part:
            s = second(ts)
            pane_end = (s // slide + 1) * slide
            if panes_first and pane_end <= before:
                continue
            for end in np.arange(pane_end, pane_end + size, slide):
                if panes_first or end > mark:
                    counts[user, int(end)] = counts.get((user, int(end)), 0) + (kind == "click")
            seen = max(seen, s)
        before, mark = mark, max(mark, int(seen * 1000) / 1000 - 5)
        before = mark if b == 2 else before  # the stop here ran a batch without events
    return {k: v for k, v in counts.items() if k[1] <= mark}


@pytest.mark.parametrize("panes_first", [False, True])
@pytest.mark.parametrize("seed", [2])
def test_pane_sums_with_late_events_and_a_restart(spark, tmp_path, seed, panes_first):
    job.use_rocksdb(spark)
    parts = batches(seed)
    for i, part in enumerate(parts):
        feed(spark, tmp_path, i, part)
        if i == 2:  # stop here, and go on later from the checkpoint
            run(spark, stateful.pane_sums(stream(spark, tmp_path), "user_id", {"clicks": F.col("event_type") == "click"}, 3600, 60, "5 seconds", panes_first), tmp_path, "out")
    found = run(spark, stateful.pane_sums(stream(spark, tmp_path), "user_id", {"clicks": F.col("event_type") == "click"}, 3600, 60, "5 seconds", panes_first), tmp_path, "out")
    got = [(r.user_id, int(r.e), r.clicks) for r in found.select("user_id", F.unix_seconds("window_end").alias("e"), "clicks").collect()]
    assert len(got) == len(set(got))
    assert {(u, e): n for u, e, n in got} == simulated(parts, panes_first)


def test_pane_state_is_one_row_per_key(spark, tmp_path):
    job.use_rocksdb(spark)
    feed(spark, tmp_path, 0, [(str(i), "ann", "click", START + dt.timedelta(seconds=i)) for i in range(3000)])
    df = stateful.pane_sums(stream(spark, tmp_path), "user_id", {"clicks": F.col("event_type") == "click"}, 3600, 60, "5 seconds")
    running = job.start(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    assert max(op["numRowsUpdated"] for p in running.recentProgress for op in p["stateOperators"]) <= 3


def test_runs_of_many_keys_stay_apart():
    rng = random.Random(3)
    for _ in range(50):
        width, since = rng.randint(1, 30), rng.randint(90, 170)
        until = since + rng.randint(1, 80)
        parts = [np.array(sorted(rng.sample(range(100, 160), rng.randint(1, 20)))) for _ in range(5)]
        sums = [np.array([[rng.randint(0, 3)] for _ in p]) for p in parts]
        numbers = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])
        got = stateful.keyed_runs(numbers, np.concatenate(parts), np.concatenate(sums), width, since, until)
        want = [(k, *run) for k, p in enumerate(parts) for run in zip(*(x.tolist() for x in stateful.runs_of(p, sums[k], width, since, until)))]
        assert list(zip(*(x.tolist() for x in got))) == want


@pytest.mark.parametrize("panes_first", [False, True])
def test_keys_share_state_rows(spark, tmp_path, monkeypatch, panes_first):
    """A call per bucket, not per key; a null key and a key that is no text come back as they were."""
    monkeypatch.setattr(stateful, "BUCKETS", 4, raising=False)
    monkeypatch.setattr(stateful, "PANES_AT_ONCE", 16, raising=False)
    job.use_rocksdb(spark)
    kind = "event_id string, user_id bigint, event_type string, ts timestamp"
    some = [(str(i), None if i % 40 == 7 else i % 40, ("click", "view")[i % 2], START + dt.timedelta(seconds=37 * i % 7000)) for i in range(300)]
    feed(spark, tmp_path, 0, some, kind)
    feed(spark, tmp_path, 1, [("end", 1, "view", START + dt.timedelta(hours=12))], kind)
    df = stateful.pane_sums(stream(spark, tmp_path, kind), "user_id", {"clicks": F.col("event_type") == "click"}, 3600, 60, "5 seconds", panes_first)
    running = job.start(df, str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    assert max(op["numRowsUpdated"] for p in running.recentProgress for op in p["stateOperators"] if "transform" in op["operatorName"].lower()) <= 12
    found = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.user_id, int(r.e)): r.clicks for r in found.select("user_id", F.unix_seconds("window_end").alias("e"), "clicks").collect()}
    assert found.count() == len(got) and got == brute(some)


def test_session_tail_equals_the_batch_features(spark, tmp_path):
    job.use_rocksdb(spark)
    rng, events, now = random.Random(4), [], 0
    for b in range(5):
        part = [
            (f"{b}-{i:02d}", rng.choice(["s1", "s2", "s3", "", None]), rng.choice(["click", "view", "purchase"]), rng.choice(["x", "y", "z", None]),
             START + dt.timedelta(seconds=now + rng.randint(0, 900)))
            for i in range(40)
        ]
        part.append((f"{b}-once", f"once-{b}", "click", "q", START + dt.timedelta(seconds=now)))
        feed(spark, tmp_path, b, part, SESSION_EVENT)
        events += part
        if b == 2:
            run(spark, stateful.session_tail(stream(spark, tmp_path, SESSION_EVENT), "1 hour", n=10), tmp_path, "tail")
        now += rng.choice([1000, 1700, 4000])
    versions = run(spark, stateful.session_tail(stream(spark, tmp_path, SESSION_EVENT), "1 hour", n=10), tmp_path, "tail")
    last = {r["session_id"]: r for r in stateful.latest_tail(versions).collect()}
    batch = spark.createDataFrame(events, SESSION_EVENT)
    want = {r["session_id"]: r for r in sessions.session_features(sessions.session_buffer(batch, cap=10), n=10).collect()}
    assert set(last) == set(want)
    mark = max(e[4] for e in events) - dt.timedelta(hours=1)
    ended = {s for s, r in want.items() if r["last_ts"] + dt.timedelta(minutes=30) <= mark}
    assert ended and ended != set(want)
    for name, row in want.items():
        assert last[name]["last_ts"] == row["last_ts"] and last[name]["expires_at"] == row["last_ts"] + dt.timedelta(minutes=30)
        assert last[name]["expired"] == (name in ended)
        if name not in ended:
            assert [last[name][c] for c in ("clicked", "viewed", "session_length")] == [row[c] for c in ("clicked", "viewed", "session_length")]
    assert rows(versions.groupBy("session_id").agg(F.count_if("expired").alias("n")).where("n > 1")) == []
