"""Queries on features, popularity and the incremental merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrack.operators import candidates as cand
from tallyrack.operators import features as feat
from tallyrack.operators import ranking
from tallyrack.plans.jobs import strengths
from tallyrack.plans.recommend import popular_responses
from workload import tables as t
from workload.registry import EV, POP, TRADES, WEIGHT, joined, query

SPLIT = f"TIMESTAMP '{t.SPLIT}'"


def _user_sql(source: str, category: str = "category_id") -> str:
    return f"""SELECT user_id, count(*) FILTER (event_type = 'click') AS total_clicks,
      count(*) FILTER (event_type = 'view') AS total_views,
      count(*) FILTER (event_type = 'purchase') AS total_purchases,
      string_agg(DISTINCT {category}, ',' ORDER BY {category}) AS category_interests,
      count(*) AS total_events FROM {source} GROUP BY user_id"""


def _item_sql(source: str) -> str:
    return f"""SELECT item_id, count(*) FILTER (event_type = 'click') AS click_count,
      count(*) FILTER (event_type = 'purchase') AS purchase_count,
      round(count(*) FILTER (event_type = 'click') / greatest(count(*) FILTER (event_type = 'view'), 1), 6) AS ctr,
      count(DISTINCT user_id) AS unique_users FROM {source} GROUP BY item_id"""


def _users_out(df):
    return df.withColumn("category_interests", joined(F.col("category_interests")))


def _items_out(df):
    return df.withColumn("ctr", F.round("ctr", 6))


@query(f"WITH {EV} {_user_sql('ev')}")
def user_features(spark, sf):
    return _users_out(feat.compute_user_features(t.events(spark, sf)))


@query(f"WITH {EV} {_item_sql('ev')}")
def item_features(spark, sf):
    return _items_out(feat.compute_item_features(t.events(spark, sf)))


@query(
    f"""WITH {TRADES}, kinds AS (SELECT trades.*, p_type AS category_id FROM trades JOIN part ON item_id = p_partkey)
    {_user_sql('kinds')}"""
)
def user_features_orders(spark, sf):
    trades = t.with_category(t.trade_events(spark, sf), spark, sf)
    return _users_out(feat.compute_user_features(trades))


@query(f"WITH {TRADES} {_item_sql('trades')}")
def item_features_orders(spark, sf):
    return _items_out(feat.compute_item_features(t.trade_events(spark, sf)))


@query(f"WITH {EV} SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def event_counts(spark, sf):
    return feat.event_counts(t.events(spark, sf))


@query(
    f"""WITH {EV}, kinds AS (SELECT unnest(['click', 'search']) AS event_type),
    pairs AS (SELECT DISTINCT user_id, kinds.event_type FROM ev, kinds)
    SELECT user_id, event_type, coalesce(n, 0) AS n FROM pairs
    LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2) c USING (user_id, event_type)"""
)
def event_counts_asked(spark, sf):
    events = t.events(spark, sf)
    kinds = F.explode(F.array(F.lit("click"), F.lit("search"))).alias("event_type")
    pairs = events.select("user_id").distinct().select("user_id", kinds)
    return feat.event_count_of(feat.event_counts(events), pairs)


@query(f"WITH {EV} SELECT item_id, sum({WEIGHT})::DOUBLE AS score FROM ev WHERE ts < TIMESTAMP '{t.AS_OF}' GROUP BY 1")
def popularity(spark, sf):
    return feat.popularity(t.events(spark, sf), F.lit(t.AS_OF))


@query(f"WITH {EV}, {POP} SELECT * FROM pop")
def popular_items(spark, sf):
    return ranking.popular_items(t.events(spark, sf))


@query(
    f"""WITH {EV} SELECT category_id, rank, item_id, score FROM (
      SELECT category_id, item_id, score,
             row_number() OVER (PARTITION BY category_id ORDER BY score DESC, item_id) AS rank
      FROM (SELECT item_id, min(category_id) AS category_id, sum({WEIGHT})::DOUBLE AS score FROM ev GROUP BY 1))
    WHERE rank <= 5"""
)
def popular_by_category(spark, sf):
    return ranking.popular_items(t.events(spark, sf), 5, by="category_id")


REQUEST_ROWS = """ids AS (
  SELECT DISTINCT user_id AS id, 'e' AS kind FROM events UNION ALL SELECT c_custkey, 'c' FROM customer),
requests AS (
  SELECT kind || id::VARCHAR AS request_id,
    CASE kind WHEN 'e' THEN id::VARCHAR ELSE 'cust-' || id::VARCHAR END AS user_id,
    CASE WHEN id % 3 = 0 THEN NULL ELSE id::VARCHAR END AS session_id,
    CASE id % 5 WHEN 0 THEN 10 WHEN 2 THEN 100 ELSE 20 END AS lim,
    CASE id % 10 WHEN 4 THEN 'emergency' WHEN 5 THEN 'critical' WHEN 6 THEN 'warning' ELSE 'normal' END AS level
  FROM ids)"""


@query(
    f"""WITH {EV}, {POP}, {REQUEST_ROWS}
    SELECT request_id, 'tier0_popular' AS tier, string_agg(item_id, ',' ORDER BY rank) AS items
    FROM requests JOIN pop ON rank <= lim GROUP BY 1"""
)
def popular_responses_by_limit(spark, sf):
    popular = ranking.popular_items(t.events(spark, sf))
    answers = popular_responses(t.requests(spark, sf), popular)
    return answers.select("request_id", "tier", joined(F.transform("items", lambda x: x["item_id"])).alias("items"))


@query(
    """WITH numbered AS (SELECT p_type AS category_id, p_partkey AS item_id,
      (row_number() OVER (ORDER BY p_type, p_partkey) - 1) // 100 AS block FROM part),
    pages AS (SELECT category_id, block, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items
              FROM numbered GROUP BY 1, 2)
    SELECT category_id, row_number() OVER (PARTITION BY category_id ORDER BY block) AS page, items FROM pages"""
)
def category_index(spark, sf):
    pages = cand.category_index(t.catalog(spark, sf), page_rows=100)
    return pages.withColumn("items", joined(F.col("items").cast("array<string>")))


@query(
    """WITH prefs AS (SELECT c_custkey AS user_id,
        unnest(['Brand#' || (c_nationkey + 1)] || CASE WHEN c_custkey % 2 = 0 THEN ['Brand#' || (c_nationkey % 7 + 1)]
               ELSE [] END) AS brand FROM customer),
    up AS (SELECT DISTINCT user_id, brand FROM prefs),
    pairs AS (SELECT c_custkey AS user_id, p_partkey AS item_id,
        EXISTS (SELECT 1 FROM up WHERE up.user_id = c_custkey AND up.brand = p_brand) AS preferred
        FROM customer, part),
    ranked AS (SELECT user_id, item_id,
        row_number() OVER (PARTITION BY user_id ORDER BY preferred DESC, item_id) AS rank FROM pairs),
    cut AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM ranked WHERE rank <= 100)
    SELECT user_id, rank, item_id, round((n - rank + 1) / n, 6) AS score FROM cut"""
)
def category_candidates(spark, sf):
    brand = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    second = F.concat(F.lit("Brand#"), (F.col("c_nationkey") % 7 + 1).cast("string"))
    prefs = F.when(F.col("c_custkey") % 2 == 0, F.array(brand, second)).otherwise(F.array(brand))
    users = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), prefs.alias("category_prefs"))
    items = t.catalog(spark, sf, "p_brand")
    found = cand.category_candidates(users, items, order=F.col("item_id"))
    return found.withColumn("score", F.round("score", 6))


@query(
    """WITH up AS (SELECT DISTINCT c_custkey AS user_id, brand FROM (
        SELECT c_custkey, unnest(CASE c_custkey % 4 WHEN 0 THEN ['Brand#' || (c_nationkey + 1)] WHEN 3 THEN
          ['Brand#' || (c_nationkey + 1), 'Size ' || (c_nationkey % 9 + 1)] ELSE []::VARCHAR[] END) AS brand FROM customer)),
    items AS (SELECT p_partkey, p_brand AS c FROM part UNION SELECT p_partkey, 'Size ' || (p_size % 9 + 1) FROM part),
    pairs AS (SELECT c_custkey AS user_id, p_partkey AS item_id,
        EXISTS (SELECT 1 FROM up JOIN items ON brand = c WHERE up.user_id = c_custkey AND items.p_partkey = part.p_partkey)
          AS preferred FROM customer, part),
    ranked AS (SELECT user_id, item_id,
        row_number() OVER (PARTITION BY user_id ORDER BY preferred DESC, item_id) AS rank FROM pairs)
    SELECT user_id, rank, item_id FROM ranked WHERE rank <= 20"""
)
def candidates_odd_prefs(spark, sf):
    """Users with a list, no list, a list of nulls, or nulls in their list; items in two categories."""
    brand = F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string"))
    size = F.concat(F.lit("Size "), (F.col("c_nationkey") % 9 + 1).cast("string"))
    null, kind = F.lit(None).cast("string"), F.col("c_custkey") % 4
    prefs = F.when(kind == 0, F.array(brand)).when(kind == 1, F.array(null)).when(kind == 3, F.array(brand, null, size))
    users = t.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), prefs.alias("category_prefs"))
    parts = t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_size")
    sizes = F.concat(F.lit("Size "), (F.col("p_size") % 9 + 1).cast("string"))
    both = parts.select("item_id", F.explode(F.array("p_brand", sizes)).alias("category_id"))
    found = cand.category_candidates(users, both, k=20, order=F.col("item_id"))
    return found.select("user_id", "rank", "item_id")


@query(
    f"""WITH {TRADES}, s AS (SELECT user_id, item_id, sum({WEIGHT})::DOUBLE AS score FROM trades GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT user_id, rank, item_id, score, p_type AS category_id, round(p_retailprice * 100)::BIGINT AS price
    FROM best JOIN part ON item_id = p_partkey
    WHERE rank <= 10 AND p_type = 'SMALL' AND round(p_retailprice * 100)::BIGINT BETWEEN 90000 AND 100000"""
)
def results_with_catalog(spark, sf):
    scores = strengths(t.trade_events(spark, sf)).withColumnRenamed("strength", "score")
    return cand.with_catalog(ranking.top_k(scores, 10), t.catalog(spark, sf), "SMALL", (90_000, 100_000))


# Incremental -----------------------------------------------------------------


def _halves(spark, sf):
    events = t.events(spark, sf)
    return events.where(F.col("ts") < F.lit(t.SPLIT)), events.where(F.col("ts") >= F.lit(t.SPLIT))


@query(f"WITH {EV} {_user_sql('ev')}")
def incremental_user_features(spark, sf):
    old, new = (feat.compute_user_features(half) for half in _halves(spark, sf))
    return _users_out(feat.merge_user_features(old, new))


@query(f"WITH {EV} {_item_sql('ev')}")
def incremental_item_features(spark, sf):
    old, new = (feat.item_user_counts(half) for half in _halves(spark, sf))
    return _items_out(feat.item_features_from_counts(feat.merge_item_counts(old, new)))


@query(
    f"""WITH {EV}, full_counts AS ({_item_sql('ev')})
    SELECT item_id, click_count, purchase_count, ctr, true AS users_close FROM full_counts"""
)
def incremental_item_sketches(spark, sf):
    """Item features from merged sketches; the distinct users must come within 5 % of the exact count."""
    old, new = (feat.item_sketches(half) for half in _halves(spark, sf))
    found = _items_out(feat.item_features_from_sketches(feat.merge_item_sketches(old, new)))
    exact = feat.compute_item_features(t.events(spark, sf)).select("item_id", F.col("unique_users").alias("exact"))
    close = F.abs(F.col("unique_users") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.join(exact, "item_id", "left").select(
        "item_id", "click_count", "purchase_count", "ctr", F.coalesce(close, F.lit(False)).alias("users_close")
    )


@query(
    f"""WITH {EV}, late AS (SELECT DISTINCT user_id FROM ev WHERE ts >= TIMESTAMP '2024-01-30 20:00:00')
    SELECT user_id, count(*) AS total_events FROM ev WHERE user_id IN (SELECT user_id FROM late) GROUP BY 1"""
)
def affected_users(spark, sf):
    events = t.events(spark, sf)
    late = events.where(F.col("ts") >= F.lit("2024-01-30 20:00:00").cast("timestamp"))
    users = events.groupBy("user_id").agg(F.count("*").alias("total_events"))
    return feat.affected(users, late)


@query(
    f"""WITH {EV}, s AS (SELECT user_id, item_id, ts >= {SPLIT} AS fresh, sum({WEIGHT})::DOUBLE AS score
                         FROM ev GROUP BY 1, 2, 3 HAVING score > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY user_id, fresh ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT user_id, rank, item_id, score FROM best
    WHERE rank <= 10 AND (fresh OR user_id NOT IN (SELECT user_id FROM s WHERE fresh))"""
)
def recs_merge(spark, sf):
    old, new = (
        ranking.top_k(strengths(half).withColumnRenamed("strength", "score"), 10) for half in _halves(spark, sf)
    )
    return feat.merge_recs(old, new)
