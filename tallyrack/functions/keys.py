"""Key names of the keyed state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The key formats that readers and writers share.
STOCK_BITMAP = "stock:bitmap"
EXPERIMENT_ACTIVE = "experiment:active"
POPULAR_USER = "popular"


def _around(prefix: str, key: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), key.cast("string"), F.lit(suffix))


def rec_top_k(user: Column) -> Column:
    return _around("rec:", user, ":top_k")


def rec_ttl(user: Column) -> Column:
    return _around("rec:", user, ":ttl")


def user_clicks_1h(user: Column) -> Column:
    return _around("feat:user:", user, ":clicks_1h")


def user_views_1d(user: Column) -> Column:
    return _around("feat:user:", user, ":views_1d")


def user_recent_items(user: Column) -> Column:
    return _around("feat:user:", user, ":recent_items")


def item_ctr_7d(item: Column) -> Column:
    return _around("feat:item:", item, ":ctr_7d")


def item_popularity(item: Column) -> Column:
    return _around("feat:item:", item, ":popularity")


def stock_bitmap() -> Column:
    return F.lit(STOCK_BITMAP)


def stock_id_map(item: Column) -> Column:
    return _around("stock:id_map:", item)


def session_events(session: Column) -> Column:
    return _around("session:", session, ":events")


def experiment_config(experiment: Column) -> Column:
    return _around("experiment:", experiment)


def experiment_active() -> Column:
    return F.lit(EXPERIMENT_ACTIVE)
