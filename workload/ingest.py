"""Queries on validation, JSON forms, keys and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrack.functions import hashing, jsonio, keys, rules, vectors
from tallyrack.operators import ingest
from tallyrack.operators.numbering import number_rows
from tallyrack.sources import events as lake
from tallyrack.sources import streams
from workload import tables as t
from workload.registry import EV, micros, query


def _raw(events):
    """Event bodies as JSON, with some fields emptied and some bodies cut short."""
    n = F.col("event_id").cast("bigint")
    body = F.to_json(
        F.struct(
            "event_type",
            F.when(n % 11 == 0, "").otherwise(F.col("user_id")).alias("user_id"),
            F.when(n % 13 == 0, "").otherwise(F.col("item_id")).alias("item_id"),
            "category_id",
            F.lit("x").alias("unknown_field"),
        )
    )
    value = F.when(n % 17 == 0, F.substring(body, 1, 10)).otherwise(body)
    return events.select(F.col("event_id").alias("source_id"), value.alias("value"))


_REASON = """CASE WHEN event_id::BIGINT % 17 = 0 THEN 'invalid JSON'
  WHEN event_type IN ('error', 'signup') THEN 'invalid event_type'
  WHEN event_id::BIGINT % 11 = 0 THEN 'user_id is required'
  WHEN event_id::BIGINT % 13 = 0 THEN 'item_id is required' END"""


@query(
    f"""WITH {EV}, judged AS (SELECT event_id AS source_id, {_REASON} AS reject_reason FROM ev)
    SELECT * FROM judged WHERE reject_reason IS NOT NULL"""
)
def event_quarantine(spark, sf):
    _, rejected = ingest.validate_events(_raw(t.events(spark, sf)))
    return rejected.select("source_id", "reject_reason")


@query(
    f"""WITH {EV}, judged AS (SELECT *, {_REASON} AS reject_reason FROM ev)
    SELECT event_id AS source_id, sha256(event_id || '|' || user_id || '|' || event_type) AS event_id, user_id,
      event_type, item_id, category_id, epoch_us(TIMESTAMP '{t.AS_OF}') AS ts_us
    FROM judged WHERE reject_reason IS NULL"""
)
def events_accepted(spark, sf):
    valid, _ = ingest.validate_events(_raw(t.events(spark, sf)))
    named = ingest.enrich_events(valid, F.lit(t.AS_OF), ["source_id", "user_id", "event_type"])
    return named.select("source_id", "event_id", "user_id", "event_type", "item_id", "category_id", micros("ts"))


@query(
    f"""WITH {EV}, judged AS (SELECT *, {_REASON} AS reject_reason FROM ev)
    SELECT user_id AS key, '{{"event_id":"' || sha256(event_id || '|' || user_id || '|' || event_type) || '","user_id":"'
      || user_id || '","event_type":"' || event_type || '","item_id":"' || item_id || '","category_id":"' || category_id
      || '","timestamp":"2024-01-30T12:00:00.000000Z","session_id":"","metadata":{{}}}}' AS value
    FROM judged WHERE reject_reason IS NULL"""
)
def ingest_stream(spark, sf):
    """Raw bodies as a stream: validated, given an id and a time, and published as messages."""
    path = t.scratch(spark, "ingest")
    valid, _ = ingest.validate_events(_raw(t.event_stream(spark, sf)))
    named = ingest.enrich_events(valid, F.lit(t.AS_OF), ["source_id", "user_id", "event_type"])
    sink = {"path": f"{path}/out"}
    streams.publish(streams.to_topic(named), "json", sink, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("key string, value string").json(sink["path"])


_MESSAGE = """'{"event_id":"' || event_id || '","user_id":"' || user_id || '","event_type":"' || event_type
  || '","item_id":"' || item_id || '","category_id":"' || category_id || '","timestamp":"'
  || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","session_id":"' || session_id || '","metadata":{'
  || array_to_string(list_filter([
       CASE WHEN event_type = 'view' THEN '"query":"q' || item_id || '"' END,
       CASE WHEN item_id <> '0' THEN '"position":' || item_id END,
       CASE WHEN round(value * 100)::BIGINT <> 0 THEN '"price":' || round(value * 100)::BIGINT END,
       CASE WHEN item_id::INT % 2 = 0 THEN '"source":"search"' END], lambda x: x IS NOT NULL), ',') || '}}'"""


@query(f"WITH {EV} SELECT user_id AS key, {_MESSAGE} AS value FROM ev")
def event_messages(spark, sf):
    return streams.to_topic(t.with_metadata(t.events(spark, sf)))


@query(
    f"""WITH {EV} SELECT event_id, user_id, event_type, item_id, category_id, session_id, epoch_us(ts) AS ts_us,
      CASE WHEN event_type = 'view' THEN 'q' || item_id ELSE '' END AS query, item_id::INT AS position,
      round(value * 100)::BIGINT AS price, CASE WHEN item_id::INT % 2 = 0 THEN 'search' ELSE '' END AS source
    FROM ev"""
)
def events_parsed(spark, sf):
    messages = streams.to_topic(t.with_metadata(t.events(spark, sf))).select("value")
    parsed = ingest.parse_events(messages).where(~F.col("parse_error"))
    return parsed.select(
        "event_id", "user_id", "event_type", "item_id", "category_id", "session_id", micros("ts"), "metadata.*"
    )


@query(
    """SELECT l_partkey::VARCHAR AS item_id, l_returnflag <> 'R' AS in_stock, l_quantity::INT AS quantity,
      epoch_us(l_shipdate) AS ts_us FROM lineitem"""
)
def inventory_parsed(spark, sf):
    body = F.to_json(F.struct("item_id", "in_stock", "quantity", F.unix_millis("ts").alias("timestamp")))
    parsed = ingest.parse_inventory(t.inventory(spark, sf).select(body.alias("value")))
    return parsed.where(~F.col("parse_error")).select("item_id", "in_stock", "quantity", micros("ts"))


@query(
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 5 WHEN 4 THEN 100 ELSE 20 END AS effective_limit
    FROM customer WHERE c_custkey % 7 <> 0"""
)
def request_limits(spark, sf):
    k = F.col("c_custkey")
    limit = (
        F.when(k % 6 == 0, "5").when(k % 6 == 1, "-1").when(k % 6 == 2, "ten").when(k % 6 == 3, " 7")
        .when(k % 6 == 4, "1000")
    )
    asked = t.table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("user_id"), limit.alias("limit")
    )
    valid, _ = ingest.validate_requests(asked)
    return valid.select("c_custkey", rules.effective_limit(F.col("limit")).alias("effective_limit"))


@query(
    """SELECT vec_id, 'item_vector: expected dim 64, got ' || (64 - vec_id % 3) AS reject_reason
    FROM embeddings WHERE vec_id % 3 <> 0"""
)
def vector_dims_rejected(spark, sf):
    vectors_ = t.table(spark, sf, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("user_vector"),
        F.slice("embedding", F.lit(1), F.lit(64) - (F.col("vec_id") % 3).cast("int")).alias("item_vector"),
    )
    _, rejected = ingest.check_dims(vectors_, {"user_vector": 64, "item_vector": 64})
    return rejected.select("vec_id", "reject_reason")


_BYTES = "[ascii(c) FOR c IN string_split(c_name, '')]"


@query(
    f"""SELECT c_custkey,
      list_reduce(list_prepend(2166136261::BIGINT, [x::BIGINT FOR x IN {_BYTES}]),
        lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS fnv,
      (list_reduce(list_prepend(2166136261::BIGINT, [x::BIGINT FOR x IN {_BYTES}]),
        lambda h, b: (xor(h, b) * 16777619) & 4294967295) % 100)::INT AS bucket,
      list_reduce(list_prepend(0::BIGINT, [x::BIGINT FOR x IN {_BYTES}]),
        lambda h, b: (31 * h + b) & 4294967295) & 2147483647 AS java_hash
    FROM customer"""
)
def key_hashes(spark, sf):
    name = F.col("c_name")
    return t.table(spark, sf, "customer").select(
        "c_custkey",
        hashing.fnv1a_32(name).alias("fnv"),
        hashing.fnv1a_bucket(name).alias("bucket"),
        hashing.java_hash_31(name).alias("java_hash"),
    )


@query(
    """SELECT c_custkey, 'rec:' || c_name || ':top_k' AS rec_top_k, 'rec:' || c_name || ':ttl' AS rec_ttl,
      'feat:user:' || c_name || ':clicks_1h' AS clicks, 'feat:user:' || c_name || ':views_1d' AS views,
      'feat:user:' || c_name || ':recent_items' AS recent, 'feat:item:' || c_name || ':ctr_7d' AS ctr,
      'feat:item:' || c_name || ':popularity' AS popularity, 'stock:bitmap' AS bitmap,
      'stock:id_map:' || c_name AS id_map, 'session:' || c_name || ':events' AS session,
      'experiment:' || c_name AS experiment, 'experiment:active' AS active FROM customer"""
)
def key_names(spark, sf):
    n = F.col("c_name")
    return t.table(spark, sf, "customer").select(
        "c_custkey",
        keys.rec_top_k(n).alias("rec_top_k"),
        keys.rec_ttl(n).alias("rec_ttl"),
        keys.user_clicks_1h(n).alias("clicks"),
        keys.user_views_1d(n).alias("views"),
        keys.user_recent_items(n).alias("recent"),
        keys.item_ctr_7d(n).alias("ctr"),
        keys.item_popularity(n).alias("popularity"),
        keys.stock_bitmap().alias("bitmap"),
        keys.stock_id_map(n).alias("id_map"),
        keys.session_events(n).alias("session"),
        keys.experiment_config(n).alias("experiment"),
        keys.experiment_active().alias("active"),
    )


@query(
    f"""WITH {EV}, leveled AS (SELECT event_id, value / 100 AS r, CASE WHEN value / 100 >= 3 THEN 3
        WHEN value / 100 >= 2 THEN 2 WHEN value / 100 >= 1.5 THEN 1 ELSE 0 END AS n FROM ev)
    SELECT event_id, ['normal', 'warning', 'critical', 'emergency'][n + 1] AS level, n < 3 AS tier1, n < 2 AS tier2,
      n < 1 AS tier3, true AS other FROM leveled"""
)
def degradation_levels(spark, sf):
    leveled = t.events(spark, sf).select("event_id", rules.load_level(F.col("value") / 100).alias("level"))
    level = F.col("level")
    return leveled.select(
        "event_id",
        "level",
        rules.tier_allowed(level, "tier1").alias("tier1"),
        rules.tier_allowed(level, "tier2").alias("tier2"),
        rules.tier_allowed(level, "tier3").alias("tier3"),
        rules.tier_allowed(level, F.lit("tier9")).alias("other"),
    )


@query(
    f"""WITH {EV}, h AS (SELECT user_id, list(DISTINCT category_id::INT ORDER BY category_id::INT) AS hist
                         FROM ev GROUP BY 1)
    SELECT user_id, array_to_string(hist || [0 FOR i IN range(greatest(12 - len(hist), 0))], ',') AS hist FROM h"""
)
def padded_histories(spark, sf):
    ids = F.sort_array(F.collect_set(F.col("category_id").cast("int")))
    hists = t.events(spark, sf).groupBy("user_id").agg(ids.alias("hist"))
    padded = vectors.pad(F.col("hist"), 12).cast("array<string>")
    return hists.select("user_id", F.array_join(padded, ",").alias("hist"))


@query(
    """SELECT batch, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last
    FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS batch FROM customer) GROUP BY 1"""
)
def fixed_batches(spark, sf):
    numbered = number_rows(t.table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])
    batch = F.floor(F.col("position") / 1000).alias("batch")
    return numbered.groupBy(batch).agg(
        F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last")
    )


@query(
    f"""WITH {EV} SELECT event_id, user_id, epoch_us(ts) AS ts_us, ts::DATE::VARCHAR AS date FROM ev
    WHERE ts >= TIMESTAMP '2024-01-30 08:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00'"""
)
def lake_slice(spark, sf):
    """Archive all events by date, then read the last four hours back."""
    path = t.scratch(spark, "lake")
    lake.archive(t.with_metadata(t.events(spark, sf)).drop("value"), path)
    found = lake.read_slice(spark, path, t.AS_OF, 4)
    return found.select("event_id", "user_id", micros("ts"), F.col("date").cast("string").alias("date"))


@query(
    f"""WITH {EV} SELECT event_type, user_id, (n)::BIGINT AS n FROM
    (SELECT event_type, user_id, count(*) AS n FROM ev GROUP BY 1, 2)"""
)
def feature_partitions(spark, sf):
    """Overwrite partitions twice; the second write replaces only the types it holds."""
    path = t.scratch(spark, "partitions")
    counts = t.events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    stale = counts.withColumn("n", F.when(F.col("event_type") == "click", -1).otherwise(F.col("n")).cast("bigint"))
    lake.write_partition(stale, path, ["event_type"])
    lake.write_counted(counts.where(F.col("event_type") == "click"), path, ["event_type"])
    return spark.read.parquet(path).select("event_type", "user_id", "n")


@query(
    f"""WITH {EV} SELECT event_id, epoch_us(date_trunc('milliseconds', ts)) AS from_millis_us,
      epoch_us(ts) AS from_text_us FROM ev"""
)
def event_times(spark, sf):
    events = t.events(spark, sf)
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.select(
        "event_id",
        F.unix_micros(jsonio.parse_time(F.unix_millis("ts").cast("string"))).alias("from_millis_us"),
        F.unix_micros(jsonio.parse_time(text)).alias("from_text_us"),
    )
