"""Session buffer and session features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.functions.rules import age_seconds
from tallyrack.operators.ranking import LAST_EVENTS, last_n
from tallyrack.operators.skew import salted_join

SESSION_TTL = 1800


def with_session(events: DataFrame) -> DataFrame:
    """Events that belong to a session. An empty id would join all visitors into one."""
    return events.where(F.coalesce(F.col("session_id").cast("string"), F.lit("")) != "")


def activity_spans(df: DataFrame, keys: list[str], ts: str, ttl: Column) -> DataFrame:
    """Cover the times at which keyed entries are alive: ``(keys, opened, until)``.

    Rows of one key within one TTL length cannot be a TTL apart, so they fold into one span
    before any ordering. A busy key is left with one row per TTL of time it was active.
    A TTL of 0 never expires and gives ``until`` = null.
    """
    lasting = ttl > 0
    seconds = F.unix_micros(F.col(ts)) / 1e6
    chunk = F.when(lasting, F.floor(seconds / ttl)).otherwise(F.lit(0))
    until = F.when(lasting, F.col(ts) + F.make_dt_interval(secs=ttl))
    return (
        df.groupBy(*keys, ttl.alias("span_ttl"), chunk.alias("chunk"))
        .agg(F.min(ts).alias("opened"), F.max(until).alias("until"))
        .select(*keys, "opened", "until")
    )


def last_life(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, alive_from, expires_at)`` of the last unbroken life of each key."""
    in_order = Window.partitionBy(*keys).orderBy("opened")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    marked = spans.withColumn("reach", F.max("until").over(before)).withColumn(
        "nth", F.row_number().over(in_order)
    )
    # a key whose earlier writes never expire has no reach, but is not new again
    fresh = (F.col("nth") == 1) | (F.col("opened") >= F.col("reach"))
    return marked.groupBy(*keys).agg(
        F.max(F.when(fresh, F.col("opened"))).alias("alive_from"), F.max("until").alias("expires_at")
    )


def session_buffer(
    events: DataFrame,
    as_of: Column | None = None,
    ttl_seconds: int = SESSION_TTL,
    cap: int | None = None,
) -> DataFrame:
    """Events held for each session: all since its last expiry, newest ``cap`` if given.

    A session expires ``ttl_seconds`` after its last event, and its events go with it.
    ``as_of`` evaluates the buffer at an instant and leaves out sessions expired by then.
    """
    rows = with_session(events)
    if as_of is not None:
        rows = rows.where(F.col("ts") <= as_of)
    lives = last_life(activity_spans(rows, ["session_id"], "ts", F.lit(ttl_seconds)), ["session_id"])
    if as_of is not None:
        lives = lives.where(F.col("expires_at") > as_of)
    held = salted_join(rows, lives, "session_id", "inner").where(F.col("ts") >= F.col("alive_from"))
    held = held.drop("alive_from")
    return held if cap is None else last_n(held, "session_id", cap).drop("rank")


def session_features(
    events: DataFrame, as_of: Column | None = None, n: int = LAST_EVENTS
) -> DataFrame:
    """Clicked and viewed items, length and last event of the newest ``n`` events per session."""
    recent = last_n(with_session(events), "session_id", n)

    def items(event_type: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("event_type") == event_type, F.col("item_id"))))

    out = recent.groupBy("session_id").agg(
        items("click").alias("clicked"),
        items("view").alias("viewed"),
        F.count("*").cast("int").alias("session_length"),
        F.max("ts").alias("last_ts"),
    )
    if as_of is not None:
        out = out.withColumn("last_event_age", age_seconds(as_of, F.col("last_ts")))
    return out


def session_items(features: DataFrame) -> DataFrame:
    """Session features -> one row per (session, item) with its flags."""
    both = F.array_union("clicked", "viewed")
    return features.select("session_id", "clicked", "viewed", F.explode(both).alias("item_id")).select(
        "session_id",
        "item_id",
        F.array_contains("clicked", F.col("item_id")).alias("clicked"),
        F.array_contains("viewed", F.col("item_id")).alias("viewed"),
    )


def recent_items(events: DataFrame, n: int = LAST_EVENTS) -> DataFrame:
    """Newest ``n`` interactions of each user as a list, newest first."""
    recent = last_n(events, "user_id", n)
    listed = F.sort_array(F.collect_list(F.struct("rank", "item_id")))
    return recent.groupBy("user_id").agg(
        F.transform(listed, lambda x: x["item_id"]).alias("items"), F.max("ts").alias("last_ts")
    )
