"""Top-K and last-N operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.operators.features import popularity

TOP_K = 100
LAST_EVENTS = 50


def first_n(df: DataFrame, by: str | list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Spark trims each input partition before the shuffle."""
    keys = [by] if isinstance(by, str) else by
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, position).where(F.col(name) <= n)


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Best ``k`` items per user; ties by item."""
    order = [F.desc("score"), F.asc("item_id")]
    return first_n(scores, "user_id", order, k).select("user_id", "rank", "item_id", "score")


def last_n(events: DataFrame, by: str, n: int = LAST_EVENTS) -> DataFrame:
    """Newest ``n`` events of each key, newest first."""
    return first_n(events, by, [F.desc("ts"), F.desc("event_id")], n)


def popular_items(
    events: DataFrame, k: int = TOP_K, by: str | None = None, as_of: Column | None = None
) -> DataFrame:
    """``(rank, item_id, score)`` by popularity, over all items or per category."""
    order = [F.desc("score"), F.asc("item_id")]
    if by is None:
        best = popularity(events, as_of).orderBy(*order).limit(k)  # TakeOrderedAndProject
        # at most k rows are left, so one task may number them
        return best.select(
            F.row_number().over(Window.orderBy(*order)).alias("rank"), "item_id", "score"
        )
    scored = popularity(events, as_of, carry=by)
    return first_n(scored, by, order, k).select(by, "rank", "item_id", "score")


def rank_score(rank: Column, n: Column) -> Column:
    """Rank (from 1) among ``n`` -> score that falls evenly from 1 to 1/n."""
    return (n - rank + 1) / n


def popular_for_limits(requests: DataFrame, popular: DataFrame, limit: str = "effective_limit") -> DataFrame:
    """Every request with the popular items up to its limit.

    ``popular`` is a top-K list, so it is packed into one row of at most K entries and
    attached by a constant key.
    """
    packed = pack_popular(popular)
    wanted = F.slice(F.col("popular"), 1, F.col(limit))
    return (
        requests.withColumn("one", F.lit(1))
        .join(F.broadcast(packed), "one", "left")
        .select(*requests.columns, F.coalesce(wanted, F.array()).alias("items"))
    )


def pack_popular(popular: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-K list -> one row ``(one, popular)`` with the array in rank order."""
    entry = F.struct(*[F.col(c) for c in ["rank", *[c for c in popular.columns if c != "rank"]]])
    return (
        popular.where(F.col("rank") <= k)
        .agg(F.sort_array(F.collect_list(entry)).alias("popular"))
        .select(F.lit(1).alias("one"), "popular")
    )
