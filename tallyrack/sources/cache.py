"""Keyed tables that take the place of cached lists: JSON value per key, with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.functions import jsonio, keys

FULL_TTL = 86_400
INCREMENTAL_TTL = 21_600


def after(as_of: Column, ttl_seconds: int) -> Column:
    return as_of + F.make_dt_interval(secs=F.lit(ttl_seconds))


def pack_recs(recs: DataFrame) -> DataFrame:
    """Top-K rows ``(user_id, rank, item_id, score)`` -> one array per user in rank order.

    The rows must come from a top-K operator: all rows of a user meet in one array.
    """
    ranked = F.sort_array(F.collect_list(F.struct("rank", "item_id", "score")))
    pairs = F.transform(ranked, lambda x: F.struct(x["item_id"].alias("item_id"), x["score"].alias("score")))
    return recs.groupBy("user_id").agg(pairs.alias("items"))


def to_cache(recs: DataFrame, ttl_seconds: int, as_of: Column) -> DataFrame:
    """Top-K rows -> ``(key, value, expires_at)`` with a JSON list per user."""
    return pack_recs(recs).select(
        keys.rec_top_k(F.col("user_id")).alias("key"),
        jsonio.recs_to_json(F.col("items")).alias("value"),
        after(as_of, ttl_seconds).alias("expires_at"),
    )


def lists_to_cache(recs: DataFrame) -> DataFrame:
    """Stored top-K rows with ``expires_at`` -> ``(key, value, expires_at)``, a JSON list per user.

    A user's rows come from one run and so have one expiry. At most top-K rows per user.
    """
    ends = recs.groupBy("user_id").agg(F.max("expires_at").alias("expires_at"))
    return pack_recs(recs).join(ends, "user_id").select(
        keys.rec_top_k(F.col("user_id")).alias("key"),
        jsonio.recs_to_json(F.col("items")).alias("value"),
        "expires_at",
    )


def popular_to_cache(popular: DataFrame) -> DataFrame:
    """The popular list under its own key; it never expires."""
    named = popular.select(F.lit(keys.POPULAR_USER).alias("user_id"), "rank", "item_id", "score")
    return pack_recs(named).select(
        keys.rec_top_k(F.col("user_id")).alias("key"),
        jsonio.recs_to_json(F.col("items")).alias("value"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )


def expire(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows that are still alive; a null expiry never ends."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def from_cache(cached: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``(key, value, expires_at)`` -> ``(user_id, rank, item_id, score)``."""
    alive = cached if as_of is None else expire(cached, as_of)
    user = F.regexp_extract("key", "^rec:(.*):top_k$", 1)
    listed = alive.where(F.col("key").rlike("^rec:.*:top_k$")).select(
        user.alias("user_id"), F.posexplode(jsonio.recs_from_json(F.col("value"))).alias("pos", "rec")
    )
    return listed.select("user_id", (F.col("pos") + 1).alias("rank"), "rec.item_id", "rec.score")


def popular_from_cache(cached: DataFrame, limit: int) -> DataFrame:
    """The cached popular list up to a limit."""
    mine = from_cache(cached.where(F.col("key") == f"rec:{keys.POPULAR_USER}:top_k"))
    return mine.where(F.col("rank") <= limit).select("rank", "item_id", "score")


def compact(spark, path: str, out: str, as_of: Column) -> None:
    """Rewrite a keyed table without its expired rows."""
    expire(spark.read.parquet(path), as_of).write.mode("overwrite").parquet(out)
