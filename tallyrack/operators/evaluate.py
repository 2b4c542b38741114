"""Measures of ranked lists against interactions that were held out."""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.operators.skew import salted_join


def leave_last_out(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rest, held)``: the newest event of every user with two or more, and all other events.

    ``held`` is ``(user_id, item_id)``. The newest is by ``(ts, event_id)``; events without a user or
    item are left out. Each event must have an ``event_id`` of its own.
    """
    known = events.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    newest = F.max_by(F.struct("event_id", "item_id"), F.struct("ts", "event_id")).alias("newest")
    lasts = known.groupBy("user_id").agg(newest, F.count("*").alias("events")).where(F.col("events") > 1)
    marked = salted_join(known, lasts.select("user_id", F.col("newest.event_id").alias("held_event")), "user_id", "left", hot_from=known)
    rest = marked.where(F.col("held_event").isNull() | (F.col("event_id") != F.col("held_event"))).select(*events.columns)
    return rest, lasts.select("user_id", F.col("newest.item_id").alias("item_id"))


def ranking_measure(lists: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """One row ``(users, hits, recall, ndcg)`` of the first ``k`` entries of each list.

    ``lists(user_id, rank, item_id)`` with ranks from 1, ``held(user_id, item_id)``. Recall and NDCG are
    means over all users that have something held out; one without a list counts 0.
    """
    wanted = held.select("user_id", "item_id").distinct()
    first = lists.where(F.col("rank") <= k).select("user_id", "item_id", "rank")
    hits = wanted.join(first, ["user_id", "item_id"], "left")
    return _mean_over_users(hits, k)


def popular_measure(popular: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """The same measure where every user gets one list, ``popular(rank, item_id)`` of ``k`` entries at most."""
    wanted = held.select("user_id", "item_id").distinct()
    first = popular.where(F.col("rank") <= k).select("item_id", "rank")
    return _mean_over_users(wanted.join(F.broadcast(first), "item_id", "left"), k)  # k rows


def _mean_over_users(hits: DataFrame, k: int) -> DataFrame:
    gain = F.when(F.col("rank").isNotNull(), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per_user = hits.groupBy("user_id").agg(F.count("*").alias("wanted"), F.count("rank").alias("hits"), F.sum(gain).alias("dcg"))
    # the best that n wanted items can reach: a list of k constants
    best = F.array(*[F.lit(x) for x in _ideal(k)])
    ideal = F.element_at(best, F.least(F.col("wanted"), F.lit(k)).cast("int"))
    return per_user.agg(
        F.count("*").alias("users"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.avg(F.col("hits") / F.col("wanted")).alias("recall"), F.avg(F.col("dcg") / ideal).alias("ndcg"),
    )


def _ideal(k: int) -> list[float]:
    out, total = [], 0.0
    for i in range(1, k + 1):
        total += 1 / log2(i + 1)
        out.append(total)
    return out
