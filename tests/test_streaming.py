import datetime as dt
import json

from pyspark.sql import functions as F

from tallyrack import schemas
from tallyrack.sources import commands as cmd
from tallyrack.sources import streams
from tallyrack.streaming import job, windows
from tests.helpers import at, rows

EVENT = "event_id string, user_id string, event_type string, ts timestamp"
START = dt.datetime(2026, 3, 18, 12)


def feed(spark, folder, n, items, schema=EVENT):
    spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(str(folder / f"part{n}"))


def stream(spark, folder, schema=EVENT):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "part*"))


def run(spark, df, folder, name):
    job.start(df, str(folder / name), str(folder / f"{name}-cp")).awaitTermination()
    return spark.read.parquet(str(folder / name))


def brute(events, size=3600, slide=60):
    out = {}
    for _, user, kind, ts in events:
        seconds = (ts - dt.datetime(1970, 1, 1)).total_seconds()
        for end in range(int(seconds // slide + 1) * slide, int(seconds // slide + 1) * slide + size, slide):
            out[user, end] = out.get((user, end), 0) + (kind == "click")
    return out


CASE = [
    ("1", "user-1", "click", START),
    ("2", "user-1", "click", START + dt.timedelta(seconds=59, microseconds=999_999)),
    ("3", "user-1", "view", START + dt.timedelta(seconds=60)),
    ("4", "only-views", "view", START + dt.timedelta(seconds=30)),
    ("5", "user-1", "click", START + dt.timedelta(hours=2)),
]


def test_batch_windows(spark):
    found = windows.clicks_1h(spark.createDataFrame(CASE, EVENT))
    got = {(r.user_id, int(r.e)): r.clicks for r in found.select("user_id", F.unix_seconds("window_end").alias("e"), "clicks").collect()}
    assert got == brute(CASE)
    assert {v for (u, _), v in got.items() if u == "only-views"} == {0}


def test_batch_windows_shuffle_twice_only(spark):
    plan = windows.clicks_1h(spark.createDataFrame(CASE, EVENT))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_unfold_after_the_last_aggregation(spark):
    events = spark.createDataFrame(CASE, EVENT)
    for found in (windows.clicks_1h(events), windows.views_1d(events)):
        plan = _plan(found)  # printed from the last step to the first
        assert 0 <= plan.index("explode(sequence(") < plan.index("HashAggregate")


def test_windows_of_dense_keys_and_null_keys(spark):
    steps = [(str(i), ("a", "b", None)[i % 3], ("click", "view")[i % 2], START + dt.timedelta(seconds=97 * i % 9000)) for i in range(300)]
    found = windows.clicks_1h(spark.createDataFrame([*steps, ("x", "a", "click", None)], EVENT))
    got = {(r.user_id, int(r.e)): r.clicks for r in found.select("user_id", F.unix_seconds("window_end").alias("e"), "clicks").collect()}
    assert got == brute(steps)


def test_current_value_sorts_no_windows(spark):
    plan = _plan(windows.current(windows.clicks_1h(spark.createDataFrame(CASE, EVENT)), "user_id", F.lit(at(60, START)), 3660))
    assert "SortAggregate" not in plan


def test_current_value(spark):
    events = spark.createDataFrame(CASE, EVENT)
    kinds = F.col("event_type") == "click"
    for seconds in (0, 30, 60, 90, 3599, 3600, 3720, 5000, 7200, 7230, 7260, 7300, 20_000):
        as_of = F.lit(at(seconds, START))
        slow = windows.current(windows.clicks_1h(events), "user_id", as_of, 3660)
        fast = windows.count_as_of(events, "user_id", kinds, 3600, 60, as_of, 3660, "clicks")
        assert rows(fast, "user_id", "window_end", "clicks", "expires_at") == rows(slow, "user_id", "window_end", "clicks", "expires_at")
    now = windows.count_as_of(events, "user_id", kinds, 3600, 60, F.lit(at(120, START)), 3660, "clicks")
    assert rows(now, "user_id", "clicks") == [("only-views", 0), ("user-1", 2)]


def test_stream_equals_batch_and_drops_late_events(spark, tmp_path):
    job.use_rocksdb(spark)
    late = ("9", "user-1", "click", START + dt.timedelta(seconds=1))
    near = ("8", "user-1", "click", START + dt.timedelta(hours=1, seconds=58))
    feed(spark, tmp_path, 0, CASE[:4])
    feed(spark, tmp_path, 1, [("7", "user-1", "view", START + dt.timedelta(hours=1, minutes=1, seconds=2))])
    feed(spark, tmp_path, 2, [near, CASE[4]])
    feed(spark, tmp_path, 3, [late, ("10", "user-1", "view", START + dt.timedelta(hours=4))])
    found = run(spark, windows.clicks_1h(stream(spark, tmp_path)), tmp_path, "clicks")
    got = {(r.user_id, int(r.e)): r.clicks for r in found.select("user_id", F.unix_seconds("window_end").alias("e"), "clicks").collect()}
    kept = [*CASE, near, ("7", "user-1", "view", START + dt.timedelta(hours=1, minutes=1, seconds=2)), ("10", "user-1", "view", START + dt.timedelta(hours=4))]
    watermark = (START + dt.timedelta(hours=4) - dt.datetime(1970, 1, 1)).total_seconds() - 5
    want = {k: v for k, v in brute(kept).items() if k[1] <= watermark}
    assert got == want  # the event that is hours late changes nothing


def test_restart_neither_loses_nor_doubles(spark, tmp_path):
    job.use_rocksdb(spark)
    feed(spark, tmp_path, 0, CASE[:2])
    run(spark, windows.clicks_1h(stream(spark, tmp_path)), tmp_path, "out")
    feed(spark, tmp_path, 1, CASE[2:])
    feed(spark, tmp_path, 2, [("6", "z", "view", START + dt.timedelta(hours=8))])
    run(spark, windows.clicks_1h(stream(spark, tmp_path)), tmp_path, "out")
    found = run(spark, windows.clicks_1h(stream(spark, tmp_path)), tmp_path, "out")
    got = rows(found.select("user_id", F.unix_seconds("window_end"), "clicks"))
    assert got == sorted(((u, e, n) for (u, e), n in brute(CASE).items()), key=repr)


def test_duplicates_are_dropped_once(spark, tmp_path):
    feed(spark, tmp_path, 0, [*CASE[:2], CASE[0]])
    feed(spark, tmp_path, 1, [CASE[1], CASE[2]])
    found = run(spark, windows.dedup(stream(spark, tmp_path)), tmp_path, "once")
    assert rows(found, "event_id") == [("1",), ("2",), ("3",)]
    assert windows.dedup(spark.createDataFrame([*CASE, *CASE], EVENT)).count() == 5


def test_the_three_branches(spark, tmp_path):
    def value(i, kind, seconds, session="s1", **more):
        return (json.dumps({"event_id": f"e{i}", "user_id": "u1", "event_type": kind, "item_id": f"i{i}", "session_id": session,
                            "timestamp": 1773835200000 + int(seconds * 1000), **more}),)

    users = [value(1, "click", 0), value(2, "view", 10, session=""), value(3, "click", 20, extra=1), ("{broken",), value(4, "view", 9000, "s2")]
    goods = [(json.dumps({"item_id": i, "in_stock": s, "quantity": q, "timestamp": f"2026-03-18T12:00:{t:02d}Z"}),)
             for i, s, q, t in [("a", True, 5, 0), ("a", True, 0, 9), ("b", True, 3, 1), ("zz", True, 1, 2)]]
    goods += [("[not an item",), (json.dumps({"in_stock": True}),)]
    feed(spark, tmp_path / "u", 0, users, "value string")
    feed(spark, tmp_path / "g", 0, goods, "value string")
    source = {k: streams.stream_source(spark, "parquet", {"path": str(tmp_path / k / "part*")}) for k in "ug"}
    offsets = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, bit_offset bigint")
    started = job.run_streams(spark, source["u"], source["g"], str(tmp_path / "out"), str(tmp_path / "cp"), offsets)
    for query in started.values():
        query.awaitTermination()
    state = job.stream_state(spark, str(tmp_path / "out"))
    live = job.stream_state(spark, str(tmp_path / "out"), F.lit(at(100, START)))
    assert rows(live.where("kind = 'zset' and key like '%s1%'"), "key", "member") == [
        ("session:s1:events", "click:i1:e1"), ("session:s1:events", "click:i3:e3"),
    ]
    clicks = state.where("key = 'feat:user:u1:clicks_1h'").first()
    assert clicks.value == "2" and clicks.expires_at == at(60 + 3540 + 3660, START)
    bits = dict(rows(state.where("kind = 'bit'"), "member", "value"))
    assert bits == {"0": "1", "1": "0"}
    assert not [k for k in rows(state, "key") if "zz" in k[0]]
    gone = rows(spark.read.parquet(str(tmp_path / "out" / "rejected")), "topic", "value", "reason")
    assert gone == sorted([
        ("user_events", "{broken", "unreadable"), ("inventory", "[not an item", "unreadable"),
        ("inventory", goods[-1][0], "unreadable"), ("inventory", goods[3][0], "unknown item"),
    ])


def test_the_job_goes_on_after_a_restart(spark, tmp_path):
    """Half of the messages, a stop, the other half: the state of one run over all of them."""
    def value(i, seconds):
        return (json.dumps({"event_id": f"e{i}", "user_id": f"u{i % 3}", "event_type": "click", "item_id": "i", "session_id": f"s{i % 2}",
                            "timestamp": 1773835200000 + seconds * 1000}),)

    users = [value(i, 40 * i) for i in range(60)] + [value(99, 9000)]
    goods = [(json.dumps({"item_id": "ab"[i % 2], "in_stock": i % 3 > 0, "quantity": 5, "timestamp": f"2026-03-18T12:00:{i:02d}Z"}),) for i in range(20)]
    offsets = spark.createDataFrame([("a", 0), ("b", 1)], "item_id string, bit_offset bigint")

    def run(name, folder):
        source = {k: streams.stream_source(spark, "parquet", {"path": str(folder / k / "part*")}) for k in "ug"}
        for query in job.run_streams(spark, source["u"], source["g"], str(folder / "out"), str(folder / "cp"), offsets).values():
            query.awaitTermination()
        columns = "key", "kind", "member", "value", "score", "expires_at"
        stored = job.fold_commands(spark, str(folder / "out"), str(folder / "state"), str(folder / "fold"))
        state = rows(job.stream_state(spark, str(folder / "out")), *columns)
        assert rows(stored, *columns) == state  # folded step by step as well as all at once
        return state

    whole, halves = tmp_path / "whole", tmp_path / "halves"
    for folder in (whole, halves):
        feed(spark, folder / "u", 0, users[:30], "value string")
        feed(spark, folder / "g", 0, goods[:10], "value string")
    run("first", halves)
    for folder in (whole, halves):
        feed(spark, folder / "u", 1, users[30:], "value string")
        feed(spark, folder / "g", 1, goods[10:], "value string")
    assert run("second", halves) == run("all", whole)


def test_publish_to_files(spark, tmp_path):
    event = ("e", "user-1", "click", "i", "c", at(0), "s", ("", 0, 0, ""))
    messages = streams.to_topic(spark.createDataFrame([event], schemas.EVENT))
    streams.publish(messages, "json", {"path": str(tmp_path / "topic")})
    row = spark.read.schema("key string, value string").json(str(tmp_path / "topic")).first()
    assert row.key == "user-1" and json.loads(row.value)["event_id"] == "e"
    stream_in = spark.readStream.schema("key string, value string").json(str(tmp_path / "topic"))
    streams.publish(stream_in, "json", {"path": str(tmp_path / "again")}, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "again")).count() == 1


def test_sequence_is_repeatable(spark):
    c = spark.createDataFrame([("k", "SET", str(i), "", 0.0, 0, at(0)) for i in range(20)], "key string, operation string, value string, field string, score double, ttl_seconds bigint, ts timestamp")
    values = {cmd.apply_commands(cmd.sequenced(c.repartition(n)))[0].first().value for n in (1, 3, 7)}
    assert len(values) == 1


def test_click_log_holds_runs_of_equal_counts(spark, tmp_path):
    job.use_rocksdb(spark)
    schema = f"{EVENT}, session_id string, item_id string"
    events = [(*e, "s", "i") for e in CASE] + [("6", "z", "view", START + dt.timedelta(hours=8), "s", "i")]
    feed(spark, tmp_path, 0, events[:3], schema)
    feed(spark, tmp_path, 1, events[3:], schema)
    written = run(spark, job.click_branch(stream(spark, tmp_path, schema)), tmp_path, "clicks")
    want = {(f"feat:user:{u}:clicks_1h", str(n), e) for (u, e), n in brute(CASE).items()}
    assert written.count() <= 8 < len(want)
    each = job.read_commands(spark, str(tmp_path), ["clicks"])
    assert each.columns == ["key", "operation", "value", "field", "score", "ttl_seconds", "ts", "seq", "tie"]
    got = rows(each.select("key", "value", F.unix_seconds("ts")))
    assert got == sorted(want, key=repr)  # each window once
    columns = "key", "kind", "member", "value", "expires_at", "ts"
    states = [cmd.apply_commands(job.read_commands(spark, str(tmp_path), ["clicks"], e))[0] for e in (True, False)]
    assert rows(states[0], *columns) == rows(states[1], *columns) != []


def test_writes_of_a_log_with_and_without_runs(spark):
    schema = "key string, operation string, value string, field string, score double, ttl_seconds bigint, ts timestamp"
    plain = spark.createDataFrame([("k", "SET", "1", "", 0.0, 9, at(0)), ("k", "SET", "2", "", 0.0, 9, None)], schema)
    assert cmd.each_write(plain).collect() == plain.collect()
    mixed = [("k", "SET", "1", "", 0.0, 9, at(120), at(0), 60), ("k", "SET", "2", "", 0.0, 9, at(5), None, None), ("k", "SET", "3", "", 0.0, 9, None, None, None)]
    found = cmd.each_write(spark.createDataFrame(mixed, f"{schema}, since timestamp, every_seconds bigint"))
    assert found.columns == plain.columns
    assert rows(found, "value", "ts") == sorted([("1", at(0)), ("1", at(60)), ("1", at(120)), ("2", at(5)), ("3", None)], key=repr)


def test_each_part_of_the_state_reads_its_own_commands(spark, tmp_path):
    schema = "key string, operation string, value string, field string, score double, ttl_seconds bigint, ts timestamp"
    log = [("k", "SET", "1", "", 0.0, 9, at(0)), ("z", "ZADD", "m", "", 1.0, 9, at(0)), ("b", "SETBIT", "1", "3", 0.0, 0, at(0)), ("n", None, "v", "", 0.0, 0, at(0))]
    spark.createDataFrame(log, schema).write.parquet(str(tmp_path / "log"))
    state, _ = cmd.apply_commands(cmd.sequenced(spark.read.parquet(str(tmp_path / "log"))))
    got = rows(state, "key", "kind", "member", "value", "score")
    want = [("k", "string", "", "1", None), ("z", "zset", "m", None, 1.0), ("z", "expiry", "", None, None), ("b", "bit", "3", "1", None), ("n", "zset", "v", None, None)]
    assert got == sorted(want, key=repr)
    scans = [line for line in state._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedFilters" in line]
    assert scans and all("ZADD" in line.split("PushedFilters: ")[1].split("ReadSchema")[0].replace("[SET,SETBIT,ZADD]", "")
                         or "In(operation, [SET,SETBIT])" in line for line in scans)
