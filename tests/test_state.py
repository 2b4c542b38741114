"""Sessions, stock, experiments and the command log."""

import re

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import experiments as exp
from tallyrack.operators import sessions, stock
from tallyrack.sources import commands as cmd
from tests.helpers import at, rows

SESSION = "event_id string, session_id string, ts timestamp, event_type string, item_id string"


def test_session_features(spark):
    events = [
        ("1", "sess1", at(-10), "click", "item_a"),
        ("2", "sess1", at(-5), "click", "item_b"),
        ("3", "sess2", at(-9), "view", "item_x"),
        ("4", "sess2", at(-8), "click", "item_y"),
        ("5", "sess2", at(-7), "view", "item_z"),
        ("6", "", at(-1), "click", "item_q"),
        ("7", None, at(-1), "click", "item_q"),
    ]
    found = {r.session_id: r for r in sessions.session_features(spark.createDataFrame(events, SESSION), F.lit(at(0))).collect()}
    assert set(found) == {"sess1", "sess2"}
    assert (found["sess1"].clicked, found["sess1"].session_length, found["sess1"].last_event_age) == (["item_a", "item_b"], 2, 5)
    assert (found["sess2"].clicked, found["sess2"].viewed, found["sess2"].session_length) == (["item_y"], ["item_x", "item_z"], 3)


def test_only_the_last_50_events_count(spark):
    events = [(f"{i:03d}", "s", at(i), "click", f"i{i:03d}") for i in range(60)]
    row = sessions.session_features(spark.createDataFrame(events, SESSION)).first()
    assert row.session_length == 50 and row.clicked == [f"i{i:03d}" for i in range(10, 60)]


def test_session_buffer_forgets_at_the_ttl(spark):
    times = [0, 1000, 2799, 4599, 4600, 6000]
    events = spark.createDataFrame([(str(i), "s", at(t), "view", "x") for i, t in enumerate(times)], SESSION)
    # 4599 comes exactly 1800 s after 2799: the session has expired
    assert rows(sessions.session_buffer(events), "event_id") == [("3",), ("4",), ("5",)]
    assert rows(sessions.session_buffer(events, cap=2), "event_id") == [("4",), ("5",)]
    assert rows(sessions.session_buffer(events, F.lit(at(2800))), "event_id") == [("0",), ("1",), ("2",)]
    assert sessions.session_buffer(events, F.lit(at(7800))).count() == 0


INVENTORY = "item_id string, in_stock boolean, quantity int, ts timestamp"


def test_quantity_overrides_the_flag(spark):
    rows_in = [("item-100", True, 50, at(0)), ("item-200", False, 0, at(0)), ("item-300", True, 10, at(0)), ("item-400", True, 0, at(0))]
    state = stock.stock_state(spark.createDataFrame(rows_in, INVENTORY))
    assert rows(state, "item_id", "in_stock") == [("item-100", True), ("item-200", False), ("item-300", True), ("item-400", False)]


def test_latest_event_wins_and_flips(spark):
    events = [("a", True, 1, at(0)), ("a", False, 1, at(10)), ("a", True, 1, at(5)), ("a", True, 1, at(90_000)), ("b", False, 0, at(1))]
    df = spark.createDataFrame(events, INVENTORY)
    assert rows(stock.stock_state(df), "item_id", "in_stock") == [("a", True), ("b", False)]
    assert rows(stock.stock_flips(df), "item_id", "ts", "flip") == [
        ("a", at(10), "in_to_out"), ("a", at(90_000), "out_to_in"),
    ]


def test_stock_filter_fails_open(spark):
    state = spark.createDataFrame(
        [("item_b", "1", True), ("item_c", "not_a_number", True), ("item_d", "3", False), ("item_f", None, True)],
        "item_id string, bit_offset string, out_of_stock boolean",
    )
    items = spark.createDataFrame([(i, s) for i, s in zip("abcdef", range(6))], "n string, score int")
    items = items.withColumn("item_id", F.concat(F.lit("item_"), "n"))
    assert rows(stock.filter_in_stock(items, state), "n") == [("a",), ("c",), ("d",), ("e",), ("f",)]
    assert rows(stock.probe_stock(items, state).where("out_of_stock"), "n") == [("b",)]


def test_bitmap_holds_every_bit(spark):
    state = spark.range(70_000).select(
        F.format_string("i%06d", "id").alias("item_id"), (F.col("id") % 3 == 0).alias("out_of_stock")
    )
    placed = stock.with_offsets(state)
    assert placed.agg(F.min("bit_offset"), F.max("bit_offset"), F.count_distinct("bit_offset")).first() == (0, 69_999, 70_000)
    assert placed.where(F.format_string("i%06d", "bit_offset") != F.col("item_id")).count() == 0
    packed = stock.stock_bitmap(placed)
    assert rows(packed.select(F.sum("out_of_stock_items"), F.sum(F.bitmap_count("bitmap")), F.count("*"))) == [(23_334, 23_334, 3)]
    probed = placed.join(packed.withColumnRenamed("bucket", "b"), F.bitmap_bucket_number(F.col("bit_offset") + 1) == F.col("b"))
    assert probed.where(stock.bit_is_set(F.col("bitmap"), F.col("bit_offset")) != F.col("out_of_stock")).count() == 0


def _experiments(spark, *pairs):
    return spark.createDataFrame([(i, "m-" + i, p) for i, p in pairs], "experiment_id string, model_version string, traffic_pct double")


def test_experiment_shares(spark):
    users = spark.range(10_000).select(F.concat(F.lit("user-"), F.col("id").cast("string")).alias("user_id"))
    split = exp.experiment_split(exp.assign_experiments(users, _experiments(spark, ("exp-b", 50.0), ("exp-a", 50.0))))
    shares = {r.arm: r.share for r in split.collect()}
    assert set(shares) == {"exp-a", "exp-b"} and all(0.4 < s < 0.6 for s in shares.values())
    whole = exp.assign_experiments(users.limit(1000), _experiments(spark, ("exp-full", 100.0)))
    assert whole.where("experiment_id is null").count() == 0
    nobody = exp.assign_experiments(users.limit(1000), _experiments(spark, ("x", 1.0)).limit(0))
    assert nobody.where("experiment_id is not null").count() == 0


def test_experiment_ranges(spark):
    checked = exp.check_experiments(_experiments(spark, ("a", 60.0), ("b", 50.0), ("c", 10.0), ("d", 0.0)))
    assert rows(checked, "experiment_id", "problem") == [("a", None), ("b", "cut off"), ("c", "never reached"), ("d", "no traffic")]
    split = exp.experiment_split(exp.assign_experiments(
        spark.range(2000).select(F.col("id").cast("string").alias("user_id")), _experiments(spark, ("a", 60.0), ("b", 50.0), ("c", 10.0))
    ))
    assert {r.arm for r in split.collect()} == {"a", "b"}


def test_unreadable_configs_are_skipped(spark):
    active = spark.createDataFrame([("e1",), ("e2",), ("gone",)], "experiment_id string")
    configs = spark.createDataFrame(
        [("e1", '{"id":"e1","model_version":"v1","traffic_pct":50}'), ("e2", "nope"), ("e3", '{"id":"e3"}')],
        "experiment_id string, value string",
    )
    assert rows(exp.active_experiments(active, configs)) == [("e1", "v1", 50.0, "")]


# Commands --------------------------------------------------------------------

COMMAND = "key string, operation string, value string, field string, score double, ttl_seconds bigint, ts timestamp, seq bigint"


def _commands(spark, *items):
    return spark.createDataFrame(
        [(k, op, v, f, s, ttl, at(t), i) for i, (k, op, v, f, s, ttl, t) in enumerate(items)], COMMAND
    )


def test_last_write_wins_and_unknown_operations_are_kept_apart(spark):
    state, rejected = cmd.apply_commands(
        _commands(
            spark,
            ("k", "SET", "1", "", 0.0, 60, 0),
            ("k", "SET", "2", "", 0.0, 0, 1),
            ("bits", "SETBIT", "1", "7", 0.0, 0, 2),
            ("bits", "SETBIT", "0", "7", 0.0, 0, 3),
            ("bits", "SETBIT", "1", "x", 0.0, 0, 4),
            ("k", "DEL", "", "", 0.0, 0, 5),
            ("z", "ZADD", "m", "", 1.0, 60, 6),
            ("z", "ZADD", "m", "", 2.0, 60, 7),
        )
    )
    assert rows(state.where("kind <> 'expiry'"), "key", "kind", "member", "value", "score", "expires_at") == [
        ("bits", "bit", "7", "0", None, None),
        ("k", "string", "", "2", None, None),
        ("z", "zset", "m", None, 2.0, None),
    ]
    assert rows(rejected, "operation", "reject_reason") == [("DEL", "unknown operation: DEL"), ("SETBIT", "bad bit offset")]
    assert rows(cmd.live_state(state, F.lit(at(66))), "key") == [("bits",), ("k",), ("z",)]
    assert rows(cmd.live_state(state, F.lit(at(67))), "key") == [("bits",), ("k",)]


def test_an_expired_set_starts_empty(spark):
    items = [("z", "ZADD", f"m{t}", "", float(t), 100, t) for t in (0, 99, 198, 298, 350)]
    state, _ = cmd.apply_commands(_commands(spark, *items))
    assert rows(state.where("kind = 'zset'"), "member") == [("m298",), ("m350",)]


@pytest.mark.parametrize("cut", [1, 2, 3, 4])
def test_steps_give_the_same_state_as_one_run(spark, tmp_path, cut):
    items = [("z", "ZADD", f"m{t}", "", float(t), 100, t) for t in (0, 99, 198, 298, 350)]
    items += [("k", "SET", str(t), "", 0.0, 5, t) for t in (400, 401)]
    all_commands = _commands(spark, *items)
    whole, _ = cmd.apply_commands(all_commands)
    first, _ = cmd.apply_commands(all_commands.where(F.col("seq") < cut))
    first.write.parquet(str(tmp_path / "s"))
    second, _ = cmd.apply_commands(all_commands.where(F.col("seq") >= cut), spark.read.parquet(str(tmp_path / "s")), hot_rows=1)
    assert rows(second.where("kind <> 'expiry'")) == rows(whole.where("kind <> 'expiry'"))
    assert rows(second.where("kind = 'expiry'"), "key", "expires_at") == [("z", at(450))]


def test_commands_of_the_three_branches(spark):
    clicks = cmd.click_commands(spark.createDataFrame([("user-1", 2, at(0))], "user_id string, clicks int, ts timestamp"))
    assert clicks.first()[:6] == ("feat:user:user-1:clicks_1h", "SET", "2", "", 0.0, 3660)
    events = spark.createDataFrame([("e1", "s1", at(0), "click", "i1"), ("e2", "", at(0), "click", "i1")], SESSION)
    found = cmd.session_commands(events).collect()
    assert len(found) == 1
    assert found[0][:3] == ("session:s1:events", "ZADD", "click:i1:e1") and found[0].ttl_seconds == 1800
    inventory = spark.createDataFrame([("a", True, 0, at(0), 4), ("b", True, 9, at(0), 5)], INVENTORY + ", bit_offset bigint")
    assert rows(cmd.stock_commands(inventory), "key", "operation", "value", "field") == [
        ("stock:bitmap", "SETBIT", "0", "5"),
        ("stock:bitmap", "SETBIT", "1", "4"),
        ("stock:id_map:a", "SET", "4", ""),
        ("stock:id_map:b", "SET", "5", ""),
    ]


def test_equal_writes_fold_by_hashing_before_the_last_is_taken(spark):
    writes = [("k", "SET", str(t // 1000), "", 0.0, 60, t) for t in range(2000)] + [("k", "SET", "0", "", 0.0, 0, 2000)]
    state, _ = cmd.apply_commands(_commands(spark, *writes))
    assert rows(state, "key", "value", "expires_at", "ts", "seq") == [("k", "0", None, at(2000), 2000)]
    state, _ = cmd.apply_commands(_commands(spark, *writes[:-1]))
    assert rows(state, "key", "value", "expires_at", "ts", "seq") == [("k", "1", at(2059), at(1999), 1999)]
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[key#\d+, kind#\d+, member#\d+, value#\d+", plan)
