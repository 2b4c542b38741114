"""Catalog index, category-preference candidates and catalog enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.operators.numbering import number_rows
from tallyrack.operators.ranking import TOP_K, first_n, rank_score
from tallyrack.operators.skew import adaptive_join, salted_join


def category_index(catalog: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Items per category in pages: ``(category_id, page, items)``, at most ``page_rows`` each.

    Items are numbered in (category, item) order over the whole catalog and cut every
    ``page_rows``, so that a category with a third of the catalog still fits in small arrays.
    """
    from pyspark.sql import Window

    ordered = number_rows(catalog.select("category_id", "item_id"), ["category_id", "item_id"])
    block = F.floor(F.col("position") / page_rows)
    pages = ordered.groupBy("category_id", block.alias("block")).agg(
        F.sort_array(F.collect_list("item_id")).alias("items")
    )
    page = F.row_number().over(Window.partitionBy("category_id").orderBy("block"))
    return pages.select("category_id", page.alias("page"), "items")


def category_candidates(
    users: DataFrame,
    catalog: DataFrame,
    k: int = TOP_K,
    seed: int = 0,
    order: Column | None = None,
) -> DataFrame:
    """Up to ``k`` items per user: preferred categories first, then any other; scored by rank.

    ``users(user_id, category_prefs)``. Items come in a seeded hash order (or ``order``). Only
    the first ``k`` items of a category can be chosen, so categories are cut to ``k`` before
    they are combined. A set of categories with fewer than ``k`` items needs fewer than ``k``
    others, and these are among the first ``2k`` items of the catalog. Lists are made once per
    distinct set of categories and then handed to the users who have it. A null list, or a null
    in it, is no preference. An item in several categories is listed once.
    """
    key = F.xxhash64(F.lit(seed), F.col("item_id")) if order is None else order
    keyed = catalog.select("category_id", "item_id", key.alias("o")).distinct()
    sort = [F.col("o"), F.col("item_id")]
    entry = F.struct("o", "item_id")
    heads = (
        first_n(keyed, "category_id", sort, k)
        .groupBy("category_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("head"))
    )
    # an item stands in few categories
    named = keyed.groupBy("item_id").agg(F.min("o").alias("o"), F.collect_set("category_id").alias("categories"))
    fill = (
        named.orderBy(*sort)
        .limit(2 * k)
        .agg(F.sort_array(F.collect_list(F.struct("o", "item_id", "categories"))).alias("fill"))
        .withColumn("one", F.lit(1))
    )
    given = F.coalesce("category_prefs", F.array().cast(users.schema["category_prefs"].dataType))
    wanted = users.select("user_id", F.sort_array(F.array_distinct(F.array_compact(given))).alias("prefs"))
    sets = wanted.select("prefs").distinct()
    per_category = sets.select("prefs", F.explode("prefs").alias("category_id"))
    # one category may be in a third of all sets
    found = salted_join(per_category, heads, "category_id", "inner")
    ordered = F.array_distinct(F.sort_array(F.flatten(F.collect_list("head"))))
    preferred = found.groupBy("prefs").agg(F.slice(ordered, 1, k).alias("preferred"))
    names = F.transform("preferred", lambda x: x["item_id"])
    rest = F.filter("fill", lambda x: ~F.arrays_overlap(F.col("prefs"), x["categories"]))
    others = F.transform(rest, lambda x: x["item_id"])
    chosen = F.slice(F.concat(F.coalesce(names, F.slice(others, 1, 0)), others), 1, k)
    lists = (
        sets.join(preferred, "prefs", "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(fill), "one", "left")  # one row of at most 2k entries
        .select("prefs", F.coalesce(chosen, names).alias("chosen"))
    )
    # a third of all users may share one set
    picked = salted_join(wanted, lists, "prefs", "inner")
    rank = F.col("pos") + 1
    return picked.select("user_id", F.size("chosen").alias("n"), F.posexplode("chosen").alias("pos", "item_id")).select(
        "user_id", rank.alias("rank"), "item_id", rank_score(rank, F.col("n")).alias("score")
    )


def with_catalog(
    results: DataFrame,
    catalog: DataFrame,
    category: str | None = None,
    price: tuple[int, int] | None = None,
) -> DataFrame:
    """Add catalog columns to results; keep only a category or price range if asked."""
    if category is not None:
        catalog = catalog.where(F.col("category_id") == category)
    if price is not None:
        catalog = catalog.where(F.col("price").between(*price))
    how = "left" if category is None and price is None else "inner"
    return adaptive_join(results, catalog, "item_id", how)


def attach_vectors(
    candidates: DataFrame, users: DataFrame, items: DataFrame, dim: int
) -> DataFrame:
    """Add ``user_vector`` and ``item_vector``; missing vectors are zero."""
    from tallyrack.functions.vectors import or_zeros

    user_side = users.select("user_id", F.col("embedding").alias("user_vector"))
    item_side = items.select("item_id", F.col("embedding").alias("item_vector"))
    both = salted_join(candidates, user_side, "user_id")
    both = adaptive_join(both, item_side, "item_id")
    return both.withColumn("user_vector", or_zeros(F.col("user_vector"), dim)).withColumn(
        "item_vector", or_zeros(F.col("item_vector"), dim)
    )
