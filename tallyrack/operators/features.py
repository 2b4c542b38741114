"""User and item features, counts, popularity, and their incremental merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.operators.skew import salted_join

#: Popularity weight of an event type (this library's choice; the types without one count 0).
POPULARITY_WEIGHTS = {"view": 1.0, "click": 2.0, "add_to_cart": 3.0, "purchase": 5.0}


def _n(event_type: str) -> Column:
    return F.count_if(F.col("event_type") == event_type)


def _ctr(clicks: Column, views: Column) -> Column:
    return clicks / F.greatest(views, F.lit(1))


def compute_user_features(events: DataFrame) -> DataFrame:
    """Counts per user and the set of categories, sorted.

    Raw events fold into plain sums per (user, category), hashed and without set buffers; the
    second step gathers one row per category of a user.
    """
    per_category = events.groupBy("user_id", "category_id").agg(
        _n("click").alias("clicks"), _n("view").alias("views"), _n("purchase").alias("purchases"), F.count("*").alias("events")
    )
    return per_category.groupBy("user_id").agg(
        F.sum("clicks").alias("total_clicks"),
        F.sum("views").alias("total_views"),
        F.sum("purchases").alias("total_purchases"),
        F.sort_array(F.collect_list("category_id")).alias("category_interests"),
        F.sum("events").alias("total_events"),
    )


def item_user_counts(events: DataFrame) -> DataFrame:
    """Counts per (item, user): the mergeable state of the item features."""
    return events.groupBy("item_id", "user_id").agg(
        _n("click").alias("clicks"),
        _n("view").alias("views"),
        _n("purchase").alias("purchases"),
        _n("add_to_cart").alias("carts"),
    )


def strength_of_counts() -> Column:
    """Strength of a (user, item) pair from its stored counts."""
    w = POPULARITY_WEIGHTS
    return w["click"] * F.col("clicks") + w["view"] * F.col("views") + w["purchase"] * F.col("purchases") + w["add_to_cart"] * F.col("carts")


def item_features_from_counts(counts: DataFrame) -> DataFrame:
    """Item features from per-(item, user) counts; each pair may appear once only."""
    totals = counts.groupBy("item_id").agg(
        F.sum("clicks").alias("click_count"),
        F.sum("views").alias("view_count"),
        F.sum("purchases").alias("purchase_count"),
        F.count("user_id").alias("unique_users"),
    )
    return totals.select(
        "item_id",
        "click_count",
        "purchase_count",
        _ctr(F.col("click_count"), F.col("view_count")).alias("ctr"),
        "unique_users",
    )


def compute_item_features(events: DataFrame) -> DataFrame:
    """Counts, click-through rate and distinct users per item.

    Two plain aggregations: the first spreads a hot item over its users, the second adds up
    one row per pair. So no task holds the user set of an item.
    """
    return item_features_from_counts(item_user_counts(events))


def event_counts(events: DataFrame) -> DataFrame:
    """Count per (user, event type); streaming in update mode gives the running count."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def event_count_of(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of given (user, event type) pairs; a pair never seen has 0."""
    return pairs.join(counts, ["user_id", "event_type"], "left").fillna({"n": 0})


def popularity(
    events: DataFrame,
    as_of: Column | None = None,
    window_seconds: int | None = None,
    weights: dict[str, float] | None = None,
    carry: str | None = None,
) -> DataFrame:
    """Weighted events per item before ``as_of``, over the last ``window_seconds`` if given.

    ``carry`` names an item attribute, such as the category, to keep with the score.
    """
    if as_of is not None:
        events = events.where(F.col("ts") < as_of)
        if window_seconds is not None:
            since = as_of - F.make_dt_interval(secs=F.lit(window_seconds))
            events = events.where(F.col("ts") >= since)
    weight = F.lit(0.0)
    for event_type, value in (weights or POPULARITY_WEIGHTS).items():
        weight = F.when(F.col("event_type") == event_type, F.lit(value)).otherwise(weight)
    if carry is None:
        return events.groupBy("item_id").agg(F.sum(weight).alias("score"))
    # the events fold by hashing; the smallest of an item's few attribute values is found afterwards
    per_value = events.groupBy("item_id", carry).agg(F.sum(weight).alias("score"))
    return per_value.groupBy("item_id").agg(F.min(carry).alias(carry), F.sum("score").alias("score"))


# Incremental merge -----------------------------------------------------------


def merge_user_features(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Add the features of new events to stored ones: sums, and the union of categories."""
    both = old.unionByName(delta)
    return both.groupBy("user_id").agg(
        F.sum("total_clicks").alias("total_clicks"),
        F.sum("total_views").alias("total_views"),
        F.sum("total_purchases").alias("total_purchases"),
        # two rows per user at most: the stored one and the new one
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("category_interests")))).alias(
            "category_interests"
        ),
        F.sum("total_events").alias("total_events"),
    )


def merge_item_counts(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge per-(item, user) counts; ``item_features_from_counts`` finishes them."""
    return (
        old.unionByName(delta)
        .groupBy("item_id", "user_id")
        .agg(*[F.sum(c).alias(c) for c in ("clicks", "views", "purchases", "carts")])
    )


def item_sketches(events: DataFrame) -> DataFrame:
    """Small item state: counts and an HLL sketch of users, for approximate distinct users."""
    return events.groupBy("item_id").agg(
        _n("click").alias("clicks"),
        _n("view").alias("views"),
        _n("purchase").alias("purchases"),
        F.hll_sketch_agg("user_id").alias("users"),
    )


def merge_item_sketches(old: DataFrame, delta: DataFrame) -> DataFrame:
    return (
        old.unionByName(delta)
        .groupBy("item_id")
        .agg(
            *[F.sum(c).alias(c) for c in ("clicks", "views", "purchases")],
            F.hll_union_agg("users").alias("users"),
        )
    )


def item_features_from_sketches(state: DataFrame) -> DataFrame:
    return state.select(
        "item_id",
        F.col("clicks").alias("click_count"),
        F.col("purchases").alias("purchase_count"),
        _ctr(F.col("clicks"), F.col("views")).alias("ctr"),
        F.hll_sketch_estimate("users").alias("unique_users"),
    )


def affected(users: DataFrame, new_events: DataFrame) -> DataFrame:
    """Users with new events. The ids stay distributed."""
    active = new_events.select("user_id").distinct()
    return salted_join(users, active, "user_id", "left_semi")


def merge_recs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored top-K rows with those of refreshed users replaced."""
    refreshed = new.select("user_id").distinct()
    return old.join(refreshed, "user_id", "left_anti").unionByName(new)
