"""Queries on windows, sessions, stock, experiments and the command log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyrack.functions.jsonio import TIME_FORMAT, event_json
from tallyrack.operators import experiments as exp
from tallyrack.operators import features as feat
from tallyrack.operators import ranking, sessions, stock
from tallyrack.plans import jobs
from tallyrack.session import cut_lineage
from tallyrack.sources import commands as cmd
from tallyrack.sources import events as lake
from tallyrack.sources.cache import from_cache
from tallyrack.sources.streams import publish, stream_source
from tallyrack.streaming import job, stateful, upserts, windows
from workload import tables as t
from workload.registry import EV, INV, joined, micros, query

AS_OF = f"TIMESTAMP '{t.AS_OF}'"


def _windows_sql(key: str, measures: dict[str, str], size: int, slide: int) -> str:
    sums = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in measures.items())
    return f"""wins AS (SELECT {key}, e * {slide * 1_000_000} AS end_us, {sums}
      FROM (SELECT *, epoch_us(ts) // {slide * 1_000_000} + g AS e FROM ev, generate_series(1, {size // slide}) s(g))
      GROUP BY {key}, e)"""


CLICKS = _windows_sql("user_id", {"clicks": "event_type = 'click'"}, 3600, 60)
VIEWS = _windows_sql("user_id", {"views": "event_type = 'view'"}, 86_400, 3600)
CTR = _windows_sql("item_id", {"clicks": "event_type = 'click'", "views": "event_type = 'view'"}, 604_800, 86_400)


@query(f"WITH {EV}, {CLICKS} SELECT user_id, end_us, clicks FROM wins")
def clicks_1h_windows(spark, sf):
    return windows.clicks_1h(t.events(spark, sf)).select("user_id", micros("window_end", "end_us"), "clicks")


_CURRENT = f"""SELECT user_id, max(end_us) AS end_us, arg_max(clicks, end_us) AS clicks,
  max(end_us) + 3660000000 AS expires_us FROM wins WHERE end_us <= epoch_us({AS_OF})
  GROUP BY user_id HAVING max(end_us) + 3660000000 > epoch_us({AS_OF})"""


@query(f"WITH {EV}, {CLICKS} {_CURRENT}")
def clicks_1h_as_of(spark, sf):
    click = F.col("event_type") == "click"
    now = windows.count_as_of(
        t.events(spark, sf), "user_id", click, windows.HOUR, 60, F.lit(t.AS_OF), windows.CLICKS_TTL, "clicks"
    )
    return now.select("user_id", micros("window_end", "end_us"), "clicks", micros("expires_at", "expires_us"))


@query(f"WITH {EV}, {CLICKS} {_CURRENT}")
def clicks_1h_current(spark, sf):
    now = windows.current(windows.clicks_1h(t.events(spark, sf)), "user_id", F.lit(t.AS_OF), windows.CLICKS_TTL)
    return now.select("user_id", micros("window_end", "end_us"), "clicks", micros("expires_at", "expires_us"))


@query(f"WITH {EV}, {VIEWS} SELECT user_id, end_us, views FROM wins")
def views_1d_windows(spark, sf):
    return windows.views_1d(t.events(spark, sf)).select("user_id", micros("window_end", "end_us"), "views")


@query(
    f"""WITH {EV}, {CTR} SELECT item_id, end_us, clicks, views, round(clicks / greatest(views, 1), 6) AS ctr
    FROM wins"""
)
def ctr_7d_windows(spark, sf):
    found = windows.ctr_7d(t.events(spark, sf))
    return found.select(
        "item_id", micros("window_end", "end_us"), "clicks", "views", F.round("ctr", 6).alias("ctr")
    )


def _run(spark, df, name):
    """Run a stream over what is there and read the written rows."""
    path = t.scratch(spark, name)
    job.start(df, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(
    f"""WITH {EV}, {CLICKS} SELECT user_id, end_us, clicks FROM wins
    WHERE end_us <= (SELECT (max(epoch_us(ts)) // 1000 - 5000) * 1000 FROM ev)"""
)
def clicks_1h_stream(spark, sf):
    job.use_rocksdb(spark)
    found = _run(spark, windows.clicks_1h(t.event_stream(spark, sf)), "clicks-stream")
    return found.select("user_id", micros("window_end", "end_us"), "clicks")


@query(
    f"""WITH {EV}, {VIEWS} SELECT user_id, end_us, views FROM wins
    WHERE end_us <= (SELECT (max(epoch_us(ts)) // 1000 - 5000) * 1000 FROM ev)"""
)
def views_1d_stream(spark, sf):
    """Daily views every hour; panes are folded in an aggregation before the keyed state of the same query."""
    job.use_rocksdb(spark)
    measures = {"views": F.col("event_type") == "view"}
    found = _run(spark, stateful.pane_sums(t.event_stream(spark, sf), "user_id", measures, windows.DAY, windows.HOUR, windows.DELAY, True), "views-stream")
    return found.select("user_id", micros("window_end", "end_us"), "views")


@query(f"WITH {EV} SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def event_counts_stream(spark, sf):
    """Running counts in update mode, merged by key and batch at reading."""
    job.use_rocksdb(spark)
    path = t.scratch(spark, "counts-stream")
    upserts.start(feat.event_counts(t.event_stream(spark, sf)), path, f"{path}-cp").awaitTermination()
    return upserts.read(spark, path, ["user_id", "event_type"])


@query(f"WITH {EV} SELECT event_id, user_id, event_type FROM ev")
def events_dedup_stream(spark, sf):
    """Every event arrives twice and is kept once."""
    job.use_rocksdb(spark)
    once = t.event_stream(spark, sf).select("event_id", "user_id", "event_type", "ts")
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, windows.dedup(twice), "dedup").select("event_id", "user_id", "event_type")


@query(f"WITH {EV} SELECT event_id, ts::DATE::VARCHAR AS date FROM ev")
def archive_stream(spark, sf):
    from tallyrack.sources.events import archive

    path = t.scratch(spark, "archive")
    archive(t.event_stream(spark, sf), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_id", F.col("date").cast("string").alias("date"))


# Sessions --------------------------------------------------------------------

_TAIL = """tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id
  ORDER BY ts DESC, event_id DESC) AS rank FROM ev) WHERE rank <= 50)"""
SESSION_FEATURES = f"""{_TAIL}, feats AS (SELECT session_id,
    coalesce(list(DISTINCT item_id ORDER BY item_id) FILTER (event_type = 'click'), []) AS clicked,
    coalesce(list(DISTINCT item_id ORDER BY item_id) FILTER (event_type = 'view'), []) AS viewed,
    count(*)::INT AS session_length, max(ts) AS last_ts FROM tail GROUP BY 1)"""


@query(f"WITH {EV}, {_TAIL} SELECT session_id, rank, event_id FROM tail")
def session_tail(spark, sf):
    return ranking.last_n(t.events(spark, sf), "session_id").select("session_id", "rank", "event_id")


@query(
    f"""WITH {EV}, {SESSION_FEATURES} SELECT session_id, array_to_string(clicked, ',') AS clicked,
    array_to_string(viewed, ',') AS viewed, session_length,
    epoch_us(date_trunc('second', TIMESTAMP '2024-02-01')) // 1000000 - epoch_us(last_ts) // 1000000 AS last_event_age
    FROM feats"""
)
def session_features(spark, sf):
    as_of = F.lit("2024-02-01").cast("timestamp")
    found = sessions.session_features(t.events(spark, sf), as_of)
    return found.select(
        "session_id", joined(F.col("clicked")).alias("clicked"), joined(F.col("viewed")).alias("viewed"),
        "session_length", "last_event_age",
    )


@query(
    f"""WITH {EV}, {SESSION_FEATURES}, x AS (SELECT session_id, clicked, viewed,
      unnest(list_distinct(clicked || viewed)) AS item_id FROM feats)
    SELECT session_id, item_id, list_contains(clicked, item_id) AS clicked, list_contains(viewed, item_id) AS viewed
    FROM x"""
)
def session_items(spark, sf):
    return sessions.session_items(sessions.session_features(t.events(spark, sf)))


_BUFFER = """gaps AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id)
      + INTERVAL 1800 SECOND, true) AS fresh FROM ev),
  lives AS (SELECT session_id, max(ts) FILTER (fresh) AS alive_from, max(ts) + INTERVAL 1800 SECOND AS expires_at
            FROM gaps GROUP BY 1)"""


@query(
    f"""WITH {EV}, {_BUFFER} SELECT event_id, ev.session_id, epoch_us(expires_at) AS expires_us
    FROM ev JOIN lives ON ev.session_id = lives.session_id AND ts >= alive_from"""
)
def session_buffer(spark, sf):
    held = sessions.session_buffer(t.events(spark, sf))
    return held.select("event_id", "session_id", micros("expires_at", "expires_us"))


@query(
    f"""WITH {EV}, {_BUFFER}, mark AS (SELECT (max(epoch_us(ts)) // 1000 - 5000) * 1000 AS us FROM ev),
    held AS (SELECT ev.*, expires_at, row_number() OVER (PARTITION BY ev.session_id ORDER BY ts DESC, event_id DESC) AS rank
      FROM ev JOIN lives ON ev.session_id = lives.session_id AND ts >= alive_from),
    feats AS (SELECT session_id, epoch_us(any_value(expires_at)) AS expires_us,
        string_agg(DISTINCT item_id, ',' ORDER BY item_id) FILTER (event_type = 'click') AS clicked,
        string_agg(DISTINCT item_id, ',' ORDER BY item_id) FILTER (event_type = 'view') AS viewed, count(*)::INT AS n
      FROM held WHERE rank <= 50 GROUP BY 1),
    ended AS (SELECT *, expires_us <= (SELECT us FROM mark) AS expired FROM feats)
    SELECT session_id, CASE WHEN expired THEN '' ELSE coalesce(clicked, '') END AS clicked,
      CASE WHEN expired THEN '' ELSE coalesce(viewed, '') END AS viewed,
      CASE WHEN expired THEN 0 ELSE n END AS session_length, expires_us, expired FROM ended"""
)
def session_tail_stream(spark, sf):
    """Session features kept by a stream, and the sessions whose state went when they expired."""
    job.use_rocksdb(spark)
    found = stateful.latest_tail(_run(spark, stateful.session_tail(t.event_stream(spark, sf), windows.DELAY), "session-tail"))
    return found.select(
        "session_id", joined(F.col("clicked")).alias("clicked"), joined(F.col("viewed")).alias("viewed"), "session_length",
        micros("expires_at", "expires_us"), "expired",
    )


@query(
    f"""WITH {EV} SELECT user_id, string_agg(item_id, ',' ORDER BY rank) AS items FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM ev) WHERE rank <= 50 GROUP BY 1"""
)
def recent_items(spark, sf):
    return sessions.recent_items(t.events(spark, sf)).select("user_id", joined(F.col("items")).alias("items"))


# Stock -----------------------------------------------------------------------

STATE = f"""{INV}, state AS (SELECT item_id, arg_max(ok, rn) AS in_stock, max(ts) AS ts FROM inv GROUP BY 1)"""


def _state(spark, sf):
    return stock.stock_state(t.inventory(spark, sf), t.INVENTORY_TIES)


@query(f"WITH {STATE} SELECT item_id, in_stock, NOT in_stock AS out_of_stock, epoch_us(ts) AS ts_us FROM state")
def stock_state(spark, sf):
    return _state(spark, sf).select("item_id", "in_stock", "out_of_stock", micros("ts"))


@query(
    f"""WITH {INV}, lagged AS (SELECT *, lag(ok) OVER (PARTITION BY item_id ORDER BY rn) AS previous FROM inv)
    SELECT item_id, epoch_us(ts) AS ts_us, l_orderkey, l_linenumber,
      CASE WHEN previous THEN 'in_to_out' ELSE 'out_to_in' END AS flip
    FROM lagged WHERE previous IS NOT NULL AND previous <> ok"""
)
def stock_flips(spark, sf):
    flips = stock.stock_flips(t.inventory(spark, sf), t.INVENTORY_TIES, width_seconds=90 * 86_400)
    return flips.select("item_id", micros("ts"), "l_orderkey", "l_linenumber", "flip")


@query(
    """SELECT l_returnflag, count(*) AS updates, max(l_linenumber)::DOUBLE AS max_lag_seconds
    FROM lineitem GROUP BY 1"""
)
def stock_update_lag(spark, sf):
    late = t.inventory(spark, sf).withColumn(
        "apply_ts", F.col("ts") + F.make_dt_interval(secs=F.col("l_linenumber"))
    )
    return stock.update_lag(late, ["l_returnflag"])


@query(
    f"""WITH {STATE}, placed AS (SELECT item_id, NOT in_stock AS out_of_stock,
      row_number() OVER (ORDER BY item_id) - 1 AS o FROM state)
    , bits AS (SELECT o // 32768 + 1 AS bucket, (o % 32768) // 8 AS byte, sum(1 << (o % 8)::INT) AS v, count(*) AS n
      FROM placed WHERE out_of_stock GROUP BY 1, 2)
    , bytes AS (SELECT bucket, byte, coalesce(v, 0)::INT AS v FROM (SELECT DISTINCT bucket FROM bits)
      CROSS JOIN generate_series(0, 4095) g(byte) LEFT JOIN bits USING (bucket, byte))
    SELECT bytes.bucket, md5(string_agg(printf('%02X', v), '' ORDER BY byte)) AS bitmap_md5,
      (SELECT sum(n)::BIGINT FROM bits b WHERE b.bucket = bytes.bucket) AS out_of_stock_items
    FROM bytes GROUP BY bytes.bucket"""
)
def stock_bitmap(spark, sf):
    packed = stock.stock_bitmap(stock.with_offsets(_state(spark, sf)))
    # the bucket number counts positions from 1
    return packed.select("bucket", F.md5(F.hex("bitmap").cast("binary")).alias("bitmap_md5"), "out_of_stock_items")


@query(
    f"""WITH {STATE} SELECT item_id, NOT in_stock AS out_of_stock, NOT in_stock AS bit FROM state"""
)
def stock_bit_probe(spark, sf):
    """Read every item's bit back from the packed bitmap."""
    placed = stock.with_offsets(_state(spark, sf))
    packed = stock.stock_bitmap(placed).select("bucket", "bitmap")
    bucket = F.bitmap_bucket_number(F.col("bit_offset") + 1)
    probed = placed.withColumn("bucket", bucket).join(packed, "bucket", "left")
    bit = F.coalesce(stock.bit_is_set(F.col("bitmap"), F.col("bit_offset")), F.lit(False))
    return probed.select("item_id", "out_of_stock", bit.alias("bit"))


def stock_table(spark, sf):
    """Stock as a stored table, with offsets as text; every seventh cannot be read."""
    item = F.col("item_id").cast("bigint")
    offset = F.when(item % 7 == 0, F.lit("bad")).otherwise(F.col("item_id"))
    return cut_lineage(_state(spark, sf).select("item_id", offset.alias("bit_offset"), "out_of_stock"))


BLOCKED = f"{STATE}, blocked AS (SELECT item_id FROM state WHERE NOT in_stock AND item_id::BIGINT % 7 <> 0)"
_ASKED = "asked AS (SELECT p_partkey::VARCHAR AS item_id FROM part UNION ALL SELECT 'new-' || p_partkey FROM part)"


def _asked(spark, sf):
    item = F.col("p_partkey").cast("string")
    both = F.explode(F.array(item, F.concat(F.lit("new-"), item)))
    return t.table(spark, sf, "part").select(both.alias("item_id"))


@query(f"WITH {BLOCKED}, {_ASKED} SELECT item_id FROM asked WHERE item_id NOT IN (SELECT item_id FROM blocked)")
def stock_filter(spark, sf):
    return stock.filter_in_stock(_asked(spark, sf), stock_table(spark, sf))


@query(
    f"""WITH {BLOCKED}, {_ASKED} SELECT item_id, item_id IN (SELECT item_id FROM blocked) AS out_of_stock FROM asked"""
)
def stock_probe(spark, sf):
    return stock.probe_stock(_asked(spark, sf), stock_table(spark, sf))


# Experiments -----------------------------------------------------------------

_FNV = """(list_reduce(list_prepend(2166136261::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({0}, '')]),
  lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 100)::INT"""


def arm_sql(user: str) -> tuple[str, str, str]:
    bucket = _FNV.format(user)
    arm = f"CASE WHEN {bucket} < 30 THEN 'exp-a' WHEN {bucket} < 60 THEN 'exp-b' WHEN {bucket} < 80 THEN 'exp-c' END"
    model = f"CASE WHEN {bucket} < 30 THEN 'v1' WHEN {bucket} < 60 THEN 'v2' WHEN {bucket} < 80 THEN 'v3' END"
    return bucket, arm, model


_B, _ARM, _MODEL = arm_sql("user_id")
_CUSTOMERS = "cust AS (SELECT 'user-' || c_custkey AS user_id FROM customer)"


def _customers(spark, sf):
    return t.table(spark, sf, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_id")
    )


@query(f"WITH {_CUSTOMERS} SELECT user_id, {_B} AS bucket, {_ARM} AS experiment_id, {_MODEL} AS model_version FROM cust")
def experiment_assignment(spark, sf):
    return exp.assign_experiments(_customers(spark, sf), t.experiments(spark))


@query(
    f"""WITH {_CUSTOMERS}, a AS (SELECT coalesce({_ARM}, 'control') AS arm FROM cust)
    SELECT arm, count(*) AS users, round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY 1"""
)
def experiment_split(spark, sf):
    split = exp.experiment_split(exp.assign_experiments(_customers(spark, sf), t.experiments(spark)))
    return split.withColumn("share", F.round("share", 6))


@query(
    f"""WITH {EV} SELECT user_id, {_ARM} AS experiment_id, {_MODEL} AS model_version, epoch_us(ts) AS ts_us
    FROM ev WHERE {_ARM} IS NOT NULL"""
)
def experiment_exposures(spark, sf):
    found = exp.exposures(exp.assign_experiments(t.events(spark, sf), t.experiments(spark)))
    return found.select("user_id", "experiment_id", "model_version", micros("ts"))


@query(
    f"""WITH {EV} SELECT user_id, {_ARM} AS experiment_id, {_MODEL} AS model_version, epoch_us(ts) AS ts_us
    FROM ev WHERE {_ARM} IS NOT NULL"""
)
def experiment_exposures_stream(spark, sf):
    """The exposure log as an append stream: each event meets the stored experiments."""
    found = exp.exposures(exp.assign_experiments(t.event_stream(spark, sf), t.experiments(spark)))
    return _run(spark, found, "exposures-stream").select("user_id", "experiment_id", "model_version", micros("ts"))


def _kind_experiments(spark, sf):
    """One experiment per part type, with a share by its number of parts."""
    kinds = t.table(spark, sf, "part").groupBy(F.col("p_type").alias("experiment_id"))
    return kinds.agg((F.count("*") % 30 + 5).cast("double").alias("traffic_pct"))


_KINDS = "kinds AS (SELECT p_type AS experiment_id, (count(*) % 30 + 5)::DOUBLE AS traffic_pct FROM part GROUP BY 1)"


@query(
    f"""WITH {_KINDS}, r AS (SELECT *, sum(traffic_pct) OVER (ORDER BY experiment_id) AS hi FROM kinds)
    SELECT experiment_id, traffic_pct, hi, hi - traffic_pct AS lo, CASE WHEN hi - traffic_pct >= 100 THEN 'never reached'
      WHEN hi > 100 THEN 'cut off' END AS problem FROM r"""
)
def experiment_check(spark, sf):
    return exp.check_experiments(_kind_experiments(spark, sf))


@query(
    f"""WITH {_KINDS}, r AS (SELECT experiment_id, traffic_pct AS lo, traffic_pct + 3 AS hi FROM kinds)
    SELECT *, coalesce(lo < max(hi) OVER (ORDER BY lo, experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      false) AS overlaps FROM r"""
)
def experiment_overlaps(spark, sf):
    declared = _kind_experiments(spark, sf).select(
        "experiment_id", F.col("traffic_pct").alias("lo"), (F.col("traffic_pct") + 3).alias("hi")
    )
    return exp.overlapping_ranges(declared)


@query(
    f"""WITH {_KINDS} SELECT experiment_id, 'm-' || experiment_id AS model_version, traffic_pct, '' AS tier_config
    FROM kinds WHERE experiment_id NOT IN ('SMALL', 'LARGE')"""
)
def active_experiments(spark, sf):
    """Of the stored configurations, SMALL is inactive and LARGE cannot be read."""
    kinds = _kind_experiments(spark, sf)
    value = F.to_json(
        F.struct(
            F.col("experiment_id").alias("id"),
            F.concat(F.lit("m-"), "experiment_id").alias("model_version"),
            "traffic_pct",
        )
    )
    broken = F.when(F.col("experiment_id") == "LARGE", "{oops").otherwise(value)
    active = kinds.where(F.col("experiment_id") != "SMALL").select("experiment_id")
    return exp.active_experiments(active, kinds.select("experiment_id", broken.alias("value")))


# Commands --------------------------------------------------------------------

_ALIVE = "2024-01-30 23:30:00"


@query(
    f"""WITH {EV}, {CLICKS}, {_BUFFER}, {STATE},
    clicks AS (SELECT 'feat:user:' || user_id || ':clicks_1h' AS key, 'string' AS kind, '' AS member,
        arg_max(clicks, end_us)::VARCHAR AS value, NULL::BIGINT AS score, max(end_us) + 3660000000 AS expires_us
      FROM wins GROUP BY user_id),
    sets AS (SELECT 'session:' || ev.session_id || ':events' AS key, 'zset' AS kind,
        event_type || ':' || item_id || ':' || event_id AS member, NULL AS value, epoch_us(ts) // 1000 AS score,
        epoch_us(expires_at) AS expires_us
      FROM ev JOIN lives ON ev.session_id = lives.session_id AND ts >= alive_from),
    bits AS (SELECT 'stock:bitmap', 'bit', item_id, CASE WHEN in_stock THEN '0' ELSE '1' END, NULL, NULL FROM state),
    maps AS (SELECT 'stock:id_map:' || item_id, 'string', '', item_id, NULL, NULL FROM state)
    SELECT * FROM (SELECT * FROM clicks UNION ALL SELECT * FROM sets UNION ALL SELECT * FROM bits
      UNION ALL SELECT * FROM maps)
    WHERE expires_us IS NULL OR expires_us > epoch_us(TIMESTAMP '{_ALIVE}')"""
)
def command_state(spark, sf):
    """All clicks, session and stock commands applied in two steps."""
    events = t.events(spark, sf)
    clicks = windows.clicks_1h(events).select("user_id", "clicks", F.col("window_end").alias("ts"))
    status = _state(spark, sf).select(
        "item_id", "in_stock", F.lit(1).alias("quantity"), "ts", F.col("item_id").alias("bit_offset")
    )
    everything = (
        cmd.click_commands(clicks).unionByName(cmd.session_commands(events)).unionByName(cmd.stock_commands(status))
    )
    ordered = cmd.sequenced(everything)
    early = F.col("ts") < F.lit(t.SPLIT)
    first, _ = cmd.apply_commands(ordered.where(early))
    path = t.scratch(spark, "state")
    first.write.parquet(path)
    both, _ = cmd.apply_commands(ordered.where(~early), spark.read.parquet(path))
    alive = cmd.live_state(both, F.lit(_ALIVE).cast("timestamp"))
    return alive.select(
        "key", "kind", "member", "value", F.col("score").cast("bigint").alias("score"), micros("expires_at", "expires_us")
    )


@query(
    """SELECT event_id::VARCHAR AS event_id, CASE event_type WHEN 'error' THEN 'unknown operation: DEL' ELSE 'bad bit offset' END
      AS reject_reason FROM events WHERE event_type IN ('error', 'signup')"""
)
def commands_rejected(spark, sf):
    kind = F.col("event_type")
    rows = t.events(spark, sf).select(
        "event_id",
        F.lit("k").alias("key"),
        F.when(kind == "error", "DEL").when(kind == "signup", "SETBIT").otherwise("SET").alias("operation"),
        F.lit("1").alias("value"),
        F.lit("x").alias("field"),
        F.lit(0.0).alias("score"),
        F.lit(0).cast("bigint").alias("ttl_seconds"),
        "ts",
        F.unix_micros("ts").alias("seq"),
    )
    _, rejected = cmd.apply_commands(rows)
    return rejected.select("event_id", "reject_reason")


# Whole jobs ------------------------------------------------------------------


@query(
    f"""WITH {EV}, {CLICKS}, {_BUFFER},
    shut AS (SELECT * FROM wins WHERE end_us <= (SELECT (max(epoch_us(ts)) // 1000 - 5000) * 1000 FROM ev)),
    moves AS (SELECT l_partkey::VARCHAR AS item_id, l_returnflag <> 'R' AND l_quantity::INT > 0 AS ok,
        epoch_us(l_shipdate) + l_orderkey * 8 + l_linenumber AS moved_us FROM lineitem),
    newest AS (SELECT item_id, arg_max(ok, moved_us) AS ok FROM moves GROUP BY 1),
    placed AS (SELECT *, item_id::BIGINT AS o FROM newest)
    SELECT 'feat:user:' || user_id || ':clicks_1h' AS key, 'string' AS kind, '' AS member,
      arg_max(clicks, end_us)::VARCHAR AS value, max(end_us) + 3660000000 AS expires_us FROM shut GROUP BY user_id
    UNION ALL SELECT 'session:' || ev.session_id || ':events', 'zset', event_type || ':' || item_id || ':' || event_id,
      NULL, epoch_us(expires_at) FROM ev JOIN lives ON ev.session_id = lives.session_id AND ts >= alive_from
    UNION ALL SELECT 'stock:bitmap', 'bit', o::VARCHAR, CASE WHEN ok THEN '0' ELSE '1' END, NULL FROM placed
    UNION ALL SELECT 'stock:id_map:' || item_id, 'string', '', o::VARCHAR, NULL FROM placed"""
)
def streaming_job_state(spark, sf):
    """The three streaming branches over JSON messages, and the state they leave."""
    users = t.event_stream(spark, sf).withColumn("metadata", F.struct(
        F.lit("").alias("query"), F.lit(0).alias("position"), F.lit(0).cast("bigint").alias("price"),
        F.lit("").alias("source"),
    ))
    time = F.date_format("ts", TIME_FORMAT).alias("timestamp")
    goods = t.inventory_stream(spark, sf).select(
        F.to_json(F.struct("item_id", "in_stock", "quantity", time)).alias("value")
    )
    offsets = t.table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_partkey").alias("bit_offset")
    )
    path = t.scratch(spark, "job")
    # the topics: each message is encoded once, however many branches read it
    messages = {"users": users.select(event_json().alias("value")), "goods": goods}
    sent = [publish(m, "parquet", {"path": f"{path}/{k}"}, f"{path}/{k}-checkpoint") for k, m in messages.items()]
    for running in sent:
        running.awaitTermination()
    topic = {k: stream_source(spark, "parquet", {"path": f"{path}/{k}"}) for k in messages}
    started = job.run_streams(spark, topic["users"], topic["goods"], f"{path}/out", f"{path}/checkpoint", offsets)
    for running in started.values():
        running.awaitTermination()
    state = cut_lineage(job.stream_state(spark, f"{path}/out"))
    alive = cmd.live_state(state, F.lit("2000-01-01").cast("timestamp"))
    return alive.select("key", "kind", "member", "value", micros("expires_at", "expires_us"))


@query(
    f"""WITH {EV} SELECT user_id, count(*) FILTER (event_type = 'click') AS total_clicks,
      count(*) FILTER (event_type = 'view') AS total_views,
      count(*) FILTER (event_type = 'purchase') AS total_purchases,
      string_agg(DISTINCT category_id, ',' ORDER BY category_id) AS category_interests, count(*) AS total_events
    FROM ev WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16 04:00:00' GROUP BY 1"""
)
def daily_then_four_hourly(spark, sf):
    """The daily job on one day, then the four-hourly job; its stored user features."""
    root = t.scratch(spark, "jobs")
    paths = jobs.Paths(*[f"{root}/{n}" for n in ("events", "features", "vectors", "recs")])
    lake.archive(t.with_metadata(t.events(spark, sf)).drop("value"), paths.events)
    jobs.daily_full(spark, "2024-01-15", paths, k=10, rank=8)
    jobs.incremental_4h(spark, dt.datetime(2024, 1, 16, 4), paths, "date=2024-01-15", "ts=2024-01-16T04", k=10)
    users = spark.read.parquet(f"{paths.features}/user/ts=2024-01-16T04")
    return users.withColumn("category_interests", joined(F.col("category_interests")))


@query(
    f"""WITH {EV}, seen AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16 12:00:00'),
    liked AS (SELECT * FROM seen WHERE event_type IN ('view', 'click', 'purchase')),
    placed AS (SELECT DISTINCT item_id FROM liked WHERE ts < TIMESTAMP '2024-01-16'),
    runs AS (SELECT unnest([4, 8, 12]) AS h),
    moments AS (SELECT h, TIMESTAMP '2024-01-16' + to_hours(h) AS now FROM runs),
    renewed AS (SELECT DISTINCT user_id, h FROM moments JOIN seen ON ts >= now - INTERVAL 4 HOUR AND ts < now
      WHERE EXISTS (SELECT 1 FROM liked JOIN placed USING (item_id) WHERE liked.user_id = seen.user_id AND liked.ts < now))
    -- a renewed list lives six hours, so those of the first run are gone after the third
    SELECT 'user' AS kind, user_id AS id, count(*) FILTER (event_type = 'click') AS clicks,
      count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS n FROM seen GROUP BY 2
    UNION ALL SELECT 'item', item_id, count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'purchase'),
      count(DISTINCT user_id) FROM seen GROUP BY 2
    UNION ALL SELECT 'list', user_id, 0, 0, (SELECT least(count(*), 5) FROM placed) FROM (
      SELECT user_id FROM renewed GROUP BY 1 HAVING max(h) > 4
      UNION SELECT user_id FROM liked WHERE ts < TIMESTAMP '2024-01-16' AND user_id NOT IN (SELECT user_id FROM renewed))"""
)
def four_hourly_chain(spark, sf):
    """The daily job and three four-hourly runs in a row: user and item features, and the cached lists."""
    root = t.scratch(spark, "chain")
    paths = jobs.Paths(*[f"{root}/{n}" for n in ("events", "features", "vectors", "recs")])
    lake.archive(t.with_metadata(t.events(spark, sf)).drop("value"), paths.events)
    jobs.daily_full(spark, "2024-01-15", paths, k=5, rank=8)
    run = "date=2024-01-15"
    for hour in (4, 8, 12):
        base, run = run, f"ts=2024-01-16T{hour:02d}"
        jobs.incremental_4h(spark, dt.datetime(2024, 1, 16, hour), paths, base, run, k=5)
    users, items = (spark.read.parquet(f"{paths.features}/{kind}/{run}") for kind in ("user", "item"))
    lists = from_cache(spark.read.parquet(paths.lists(run)))
    zero = F.lit(0).cast("bigint")
    known = users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("total_clicks").alias("clicks"),
                         F.col("total_purchases").alias("purchases"), F.col("total_events").alias("n"))
    known = known.union(items.select(F.lit("item"), "item_id", "click_count", "purchase_count", "unique_users"))
    return known.union(lists.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit("list"), "user_id", zero, zero, "n"))


@query(
    f"""WITH {EV}, seen AS (SELECT * FROM ev WHERE event_id::BIGINT % 3 <> 2 OR event_id::BIGINT % 2 = 0)
    SELECT user_id, count(*) FILTER (event_type = 'click') AS total_clicks, count(*) FILTER (event_type = 'view') AS total_views,
      count(*) FILTER (event_type = 'purchase') AS total_purchases,
      string_agg(DISTINCT category_id, ',' ORDER BY category_id) AS category_interests, count(*) AS total_events FROM seen GROUP BY 1"""
)
def late_slices(spark, sf):
    """User features kept by slices of what arrives: events of the whole month come in two late deliveries.

    The first third is the stored base; each later delivery is taken by the cursor once, and merged.
    """
    from tallyrack.operators import features as feat

    root = t.scratch(spark, "slices")
    events = t.with_metadata(t.events(spark, sf)).drop("value")
    n = F.col("event_id").cast("bigint")
    deliveries = [n % 3 == 0, n % 3 == 1, (n % 3 == 2) & (n % 2 == 0)]
    state = None
    for i, which in enumerate(deliveries):
        lake.archive(events.where(which), f"{root}/events")
        slices = f"{root}/slices/{i}"
        lake.take_slice(spark, f"{root}/events", slices, f"{root}/cursor")
        lake.take_slice(spark, f"{root}/events", slices, f"{root}/cursor")  # nothing new
        new = feat.compute_user_features(lake.read_slices(spark, slices, lake.stored_batches(spark, slices)))
        merged = new if state is None else feat.merge_user_features(spark.read.parquet(state), new)
        state = f"{root}/users/{i}"
        merged.write.parquet(state)
    return spark.read.parquet(state).withColumn("category_interests", joined(F.col("category_interests")))
