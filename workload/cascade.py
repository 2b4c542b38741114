"""Queries on vectors, cached lists, the request cascade and the models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tallyrack.functions.vectors import dot_batch
from tallyrack.operators import candidates as cand
from tallyrack.operators import bounded, evaluate, models, nearest, ranking
from tallyrack.plans import recommend as rec
from tallyrack.plans.jobs import blend_vectors, strengths
from tallyrack.session import cut_lineage
from tallyrack.sources import cache
from workload import tables as t
from workload.features import REQUEST_ROWS
from workload.registry import EV, POP, TRADES, WEIGHT, micros, query
from workload.streams import BLOCKED, SESSION_FEATURES, arm_sql, stock_table

_DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
_PAIRS = f"""pairs AS (SELECT u.vec_id AS user_id, i.vec_id AS item_id,
    round({_DOT.format('u.embedding', 'i.embedding')}, 6) + 0.0 AS score
  FROM embeddings u JOIN embeddings i ON u.vec_id <> i.vec_id)"""


@query(
    f"""WITH {_PAIRS} SELECT * FROM (SELECT user_id,
      row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM pairs)
    WHERE rank <= 10"""
)
def nearest_topk(spark, sf):
    return nearest.nearest_items(
        t.user_vectors(spark, sf), t.item_vectors(spark, sf), 10, exclude_self=True, digits=6, block_rows=1000
    )


@query(
    f"""WITH {_PAIRS} SELECT * FROM (SELECT user_id,
      row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM pairs)
    WHERE rank <= 10"""
)
def nearest_bounded(spark, sf):
    """These vectors have no direction in common, so few cells can be left out; the rows are exact all the same."""
    return nearest.nearest_items(
        t.user_vectors(spark, sf), t.item_vectors(spark, sf), 10, "bounded", exclude_self=True, digits=6, block_rows=1000
    )


def part_vectors(spark, sf):
    """Parts by size, price and brand, each as an angle; parts of type STANDARD or SMALL weigh less."""
    two_pi = 2 * math.pi
    angles = (
        F.col("p_size") * (two_pi / 50),
        (F.col("p_retailprice") - 900) * (two_pi / 100),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") * (two_pi / 25),
    )
    weight = F.when(F.col("p_type").isin("STANDARD", "SMALL"), 0.5).otherwise(1.0)
    coordinates = [weight * f(angle) for angle in angles for f in (F.cos, F.sin)]
    return t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.array(*coordinates).alias("embedding"))


_PARTS = """angles AS (SELECT p_partkey, CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 0.5 ELSE 1.0 END AS w, p_size * (2 * pi() / 50) AS a,
    (p_retailprice - 900) * (2 * pi() / 100) AS b, regexp_extract(p_brand, '([0-9]+)', 1)::INT * (2 * pi() / 25) AS c FROM part),
  vectors AS (SELECT p_partkey AS id, [w * cos(a), w * sin(a), w * cos(b), w * sin(b), w * cos(c), w * sin(c)] AS v FROM angles)"""


@query(
    f"""WITH {_PARTS}, pairs AS (SELECT u.id AS user_id, i.id AS item_id, round(list_inner_product(u.v, i.v), 6) + 0.0 AS score
      FROM vectors u JOIN vectors i ON u.id <> i.id)
    SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, item_id, score
                   FROM pairs) WHERE rank <= 10"""
)
def similar_parts(spark, sf):
    items = part_vectors(spark, sf)
    users = items.withColumnRenamed("item_id", "user_id")
    return nearest.nearest_items(users, items, 10, "bounded", exclude_self=True, digits=6)


@query("SELECT count(*) * count(*) AS pairs, true AS all_found, true AS some_left_out, true AS most_found, true AS few_scored FROM part")
def similar_parts_work(spark, sf):
    """Sure bounds find every list; with a spread of 2 few of the pairs are enough for nearly all of them."""
    items = part_vectors(spark, sf)
    users = items.withColumnRenamed("item_id", "user_id")
    exact = nearest.nearest_items(users, items, 5, exclude_self=True, digits=6)

    def measured(spread, names):
        done = bounded.search(users, items, 5, spread=spread, exclude_self=True, digits=6)
        # two single rows
        return bounded.share_scored(done, users, items).crossJoin(nearest.recall(exact, done.found)).select("pairs", *names)

    sure = measured(None, [(F.col("recall") == 1.0).alias("all_found"), (F.col("share") < 1.0).alias("some_left_out")])
    likely = measured(2.0, [(F.col("recall") >= 0.95).alias("most_found"), (F.col("share") <= 0.2).alias("few_scored")])
    return sure.join(likely, "pairs")


@query()
def nearest_cells(spark, sf):
    return nearest.nearest_items(
        t.user_vectors(spark, sf), t.item_vectors(spark, sf), 10, "cells", cells=16, probes=8, exclude_self=True
    )


@query("SELECT (SELECT count(*) * least(count(*) - 1, 10) FROM embeddings) AS wanted, true AS half_found, true AS scores_right")
def nearest_recall(spark, sf):
    """Half of the cells must find well over half of the exact lists, and their scores must be exact."""
    users, items = t.user_vectors(spark, sf), t.item_vectors(spark, sf)
    exact = nearest.nearest_items(users, items, 10, exclude_self=True)
    found = nearest_cells(spark, sf)
    both = exact.select("user_id", "item_id", F.col("score").alias("true_score")).join(found, ["user_id", "item_id"])
    wrong = both.agg(F.count_if(F.abs(F.col("score") - F.col("true_score")) > 1e-6).alias("wrong")).withColumn("one", F.lit(1))
    share = nearest.recall(exact, found).withColumn("one", F.lit(1))
    # two single-row results
    return share.join(wrong, "one").select(
        "wanted", (F.col("recall") >= 0.6).alias("half_found"), (F.col("wrong") == 0).alias("scores_right")
    )


@query(
    f"""WITH {EV}, pairs AS (SELECT DISTINCT user_id::BIGINT AS user_id, item_id::BIGINT AS item_id FROM ev)
    SELECT user_id, item_id, round({_DOT.format('u.embedding', 'i.embedding')}, 6) + 0.0 AS score FROM pairs
    LEFT JOIN embeddings u ON u.vec_id = user_id LEFT JOIN embeddings i ON i.vec_id = item_id"""
)
def pair_scores(spark, sf):
    pairs = t.events(spark, sf).select(
        F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id")
    ).distinct()
    vectors = t.item_vectors(spark, sf)
    found = nearest.pair_score(pairs, vectors.withColumnRenamed("item_id", "user_id"), vectors)
    return found.withColumn("score", F.round("score", 6))


# Cached lists ----------------------------------------------------------------

_RECS = f"""s AS (SELECT user_id, item_id, sum({WEIGHT})::DOUBLE AS score FROM ev GROUP BY 1, 2 HAVING score > 0),
  recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s)
           WHERE rank <= 100)"""


def cached_recs(spark, sf):
    return ranking.top_k(strengths(t.events(spark, sf)).withColumnRenamed("strength", "score"))


@query(f"WITH {EV}, {_RECS} SELECT user_id, rank, item_id, score FROM recs")
def user_topk(spark, sf):
    return cached_recs(spark, sf)


@query(
    f"""WITH {TRADES}, s AS (SELECT user_id, item_id, sum({WEIGHT})::DOUBLE AS score FROM trades GROUP BY 1, 2)
    SELECT * FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank,
                   item_id, score FROM s) WHERE rank <= 100"""
)
def user_topk_orders(spark, sf):
    return ranking.top_k(strengths(t.trade_events(spark, sf)).withColumnRenamed("strength", "score"))


@query(
    f"""WITH {EV}, {_RECS} SELECT 'rec:' || user_id || ':top_k' AS key, '[' || string_agg('{{"item_id":"' || item_id
      || '","score":' || score || '}}', ',' ORDER BY rank) || ']' AS value,
      epoch_us(TIMESTAMP '{t.AS_OF}') + 86400000000 AS expires_us FROM recs GROUP BY user_id"""
)
def topk_cache(spark, sf):
    cached = cache.to_cache(cached_recs(spark, sf), cache.FULL_TTL, F.lit(t.AS_OF))
    return cached.select("key", "value", micros("expires_at", "expires_us"))


@query(f"WITH {EV}, {_RECS} SELECT user_id, rank, item_id, score FROM recs WHERE user_id::BIGINT % 2 = 0")
def topk_cache_read(spark, sf):
    """Lists of odd users have a short time to live and are gone at the time of reading."""
    recs = cached_recs(spark, sf)
    odd = F.col("user_id").cast("bigint") % 2 == 1
    old = cache.to_cache(recs.where(odd), cache.INCREMENTAL_TTL, F.lit(t.AS_OF))
    new = cache.to_cache(recs.where(~odd), cache.FULL_TTL, F.lit(t.AS_OF))
    later = cache.after(F.lit(t.AS_OF), cache.INCREMENTAL_TTL)
    return cache.from_cache(old.unionByName(new), later)


@query(f"WITH {EV}, {POP} SELECT rank, item_id, score FROM pop WHERE rank <= 20")
def popular_cache_read(spark, sf):
    cached = cache.popular_to_cache(ranking.popular_items(t.events(spark, sf)))
    return cache.popular_from_cache(cached, 20)


# Cascade ---------------------------------------------------------------------


def dot_ranker(spark, sf):
    """Model stand-in that SQL can follow: the rounded inner product of two vectors."""
    vectors = t.item_vectors(spark, sf).withColumn("item_id", F.col("item_id").cast("string"))
    users = vectors.select(F.concat(F.lit("cust-"), "item_id").alias("user_id"), "embedding")

    def rank(rows):
        ready = cand.attach_vectors(rows, users, vectors, 64)
        score = F.round(dot_batch(F.col("user_vector"), F.col("item_vector")), 6)
        return ready.withColumn("model_score", score).drop("user_vector", "item_vector")

    return rank


def _row_dots(users: np.ndarray, items: np.ndarray) -> np.ndarray:
    return np.round((users * items).sum(axis=1), 6) + 0.0


def dot_list_ranker(spark, sf) -> rec.ListRanker:
    """The same model over whole lists."""
    vectors = t.item_vectors(spark, sf).withColumn("item_id", F.col("item_id").cast("string"))
    users = vectors.select(F.concat(F.lit("cust-"), "item_id").alias("user_id"), "embedding")
    return rec.ListRanker(users, vectors, 64, _row_dots)


def _answers(spark, sf, ranker=dot_list_ranker):
    events = t.events(spark, sf)
    return rec.recommend(
        cut_lineage(t.requests(spark, sf)),  # stands for a stored request table
        cached_recs(spark, sf),
        ranking.popular_items(events),
        stock_table(spark, sf),
        events,
        ranker(spark, sf) if ranker else None,
    )


def _cascade_sql(ranker: bool) -> str:
    wants = "miss AND level = 'normal'" if ranker else "false"
    return f"""{EV}, {POP}, {_RECS}, {REQUEST_ROWS}, {BLOCKED}, {SESSION_FEATURES},
  asked AS (SELECT *, user_id NOT IN (SELECT user_id FROM recs) AS miss FROM requests),
  flagged AS (SELECT *, level = 'emergency' AS emergency, session_id IS NOT NULL AND level IN ('normal', 'warning')
      AS reranks, {wants} AS models FROM asked),
  listed AS (
    SELECT f.*, r.rank, r.item_id, r.score FROM flagged f JOIN recs r USING (user_id) WHERE NOT emergency AND NOT miss
    UNION ALL
    SELECT f.*, p.rank, p.item_id, p.score FROM flagged f JOIN pop p ON p.rank <= f.lim WHERE emergency OR miss),
  stocked AS (SELECT * FROM listed WHERE emergency OR item_id NOT IN (SELECT item_id FROM blocked)),
  adjusted AS (
    SELECT k.*, CASE WHEN reranks AND NOT emergency THEN score
        - CASE WHEN list_contains(clicked, item_id) THEN 0.5 ELSE 0 END
        - CASE WHEN list_contains(viewed, item_id) THEN 0.2 ELSE 0 END ELSE score END AS final
    FROM stocked k LEFT JOIN feats USING (session_id)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY CASE WHEN reranks AND NOT emergency THEN -final ELSE 0 END, rank) AS place FROM adjusted),
  modeled AS (
    SELECT p.*, CASE WHEN models THEN coalesce(round({_DOT.format('u.embedding', 'i.embedding')}, 6), 0.0) + 0.0 END AS m
    FROM placed p LEFT JOIN embeddings u ON user_id = 'cust-' || u.vec_id
    LEFT JOIN embeddings i ON item_id = i.vec_id::VARCHAR),
  answers AS (SELECT *, row_number() OVER (PARTITION BY request_id
      ORDER BY CASE WHEN models THEN -m ELSE 0 END, place) AS final_rank FROM modeled),
  tiers AS (SELECT *, CASE WHEN emergency THEN 'fallback_popular' WHEN models THEN 'tier3_inference'
      WHEN miss THEN 'fallback_popular' WHEN reranks THEN 'tier2_rerank' ELSE 'tier1_precomputed' END AS tier
    FROM flagged)"""


_ROWS = """SELECT request_id, final_rank AS rank, item_id, round(CASE WHEN answers.models THEN m ELSE final END, 6) AS score, tier
  FROM answers JOIN tiers USING (request_id) WHERE final_rank <= answers.lim"""


def _rows(answers):
    return rec.recommendation_rows(answers).withColumn("score", F.round("score", 6))


@query(f"WITH {_cascade_sql(True)} {_ROWS}")
def recommend_cascade(spark, sf):
    return _rows(_answers(spark, sf))


@query(f"WITH {_cascade_sql(True)} {_ROWS}")
def recommend_by_rows(spark, sf):
    """The same answers from a model that takes a row per candidate."""
    return _rows(_answers(spark, sf, dot_ranker))


@query(f"WITH {_cascade_sql(False)} {_ROWS}")
def recommend_without_model(spark, sf):
    return _rows(_answers(spark, sf, ranker=None))


_BUCKET, _ARM, _MODEL = arm_sql("t.user_id")


@query(
    f"""WITH {_cascade_sql(True)}, items AS (SELECT request_id, string_agg(item_id, ',' ORDER BY final_rank) AS items
      FROM answers WHERE final_rank <= lim GROUP BY 1)
    SELECT request_id, t.user_id, t.level AS load_level, t.tier, coalesce(items, '') AS items, {_ARM} AS experiment_id,
      {_MODEL} AS model_version FROM tiers t LEFT JOIN items USING (request_id)"""
)
def recommend_responses(spark, sf):
    full = rec.responses(_answers(spark, sf), t.experiments(spark))
    items = F.array_join(F.transform("items", lambda x: x["item_id"]), ",")
    return full.select(
        "request_id", "user_id", "load_level", "tier", items.alias("items"), "experiment_id", "model_version"
    )


# Models ----------------------------------------------------------------------


@query(
    f"""WITH {TRADES}, v AS (SELECT user_id, item_id FROM trades GROUP BY 1, 2)
    SELECT v.user_id, v.item_id, u.vec_id IS NOT NULL AS has_user, i.vec_id IS NOT NULL AS has_item,
      round(coalesce(list_sum(u.embedding::DOUBLE[]), 0), 5) + 0.0 AS user_sum,
      round(coalesce(list_sum(i.embedding::DOUBLE[]), 0), 5) + 0.0 AS item_sum
    FROM v LEFT JOIN embeddings u ON u.vec_id = v.user_id LEFT JOIN embeddings i ON i.vec_id = v.item_id"""
)
def candidate_vectors(spark, sf):
    pairs = t.trade_events(spark, sf).select("user_id", "item_id").distinct()
    vectors = t.item_vectors(spark, sf)
    full = cand.attach_vectors(pairs, vectors.withColumnRenamed("item_id", "user_id"), vectors, 64)

    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda s, x: s + x.cast("double"))

    return full.select(
        "user_id",
        "item_id",
        F.exists("user_vector", lambda x: x != 0).alias("has_user"),
        F.exists("item_vector", lambda x: x != 0).alias("has_item"),
        F.round(total("user_vector"), 5).alias("user_sum"),
        F.round(total("item_vector"), 5).alias("item_sum"),
    )


def _training(spark, sf):
    from tallyrack.operators import features as feat

    events = t.events(spark, sf)
    users = feat.compute_user_features(events).select("user_id", "total_clicks", "total_views")
    items = feat.compute_item_features(events).select("item_id", "click_count", "ctr")
    return models.training_set(events, users, items)


_TRAINING = f"""u AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS total_clicks,
    count(*) FILTER (event_type = 'view') AS total_views FROM ev GROUP BY 1),
  i AS (SELECT item_id, count(*) FILTER (event_type = 'click') AS click_count,
    count(*) FILTER (event_type = 'click') / greatest(count(*) FILTER (event_type = 'view'), 1) AS ctr
    FROM ev GROUP BY 1),
  training AS (SELECT event_id, user_id, item_id, CASE event_type WHEN 'view' THEN 0.0 ELSE 1.0 END::DOUBLE AS label,
    total_clicks, total_views, click_count, round(ctr, 6) AS ctr
    FROM ev JOIN u USING (user_id) JOIN i USING (item_id) WHERE event_type IN ('view', 'click', 'purchase'))"""
_KEY_BUCKET, _, _ = arm_sql("event_id")


@query(f"WITH {EV}, {_TRAINING} SELECT *, {_KEY_BUCKET} < 80 AS train FROM training")
def training_set(spark, sf):
    rows = _training(spark, sf)
    return rows.withColumn("ctr", F.round("ctr", 6)).withColumn("train", models.is_training(F.col("event_id")))


@query(
    f"""WITH {EV}, {_TRAINING}, scored AS (SELECT label, (ctr - 1) * 2 + click_count / 100 AS x FROM training
      WHERE {_KEY_BUCKET} >= 80)
    SELECT round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 5) AS loss, count(*) AS rows FROM scored"""
)
def holdout_loss(spark, sf):
    _, held = models.split(_training(spark, sf), "event_id")
    logit = (F.round("ctr", 6) - 1) * 2 + F.col("click_count") / 100
    return models.bce(held.withColumn("logit", logit)).withColumn("loss", F.round("loss", 5))


@query(
    f"""WITH {EV}, u AS (SELECT user_id, ts, sum(c) OVER w AS total_clicks, sum(v) OVER w AS total_views FROM (
        SELECT user_id, ts, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM ev GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT item_id, ts, sum(c) OVER w AS clicks, sum(v) OVER w AS views FROM (
        SELECT item_id, ts, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'view') AS v FROM ev GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY item_id ORDER BY ts)),
    l AS (SELECT event_id, user_id, item_id, ts, CASE event_type WHEN 'view' THEN 0.0 ELSE 1.0 END::DOUBLE AS label
      FROM ev WHERE event_type IN ('view', 'click', 'purchase'))
    SELECT event_id, l.user_id, l.item_id, label, coalesce(total_clicks, 0)::BIGINT AS total_clicks,
      coalesce(total_views, 0)::BIGINT AS total_views, coalesce(clicks, 0)::BIGINT AS click_count,
      round(coalesce(clicks, 0) / greatest(coalesce(views, 0), 1), 6) AS ctr
    FROM l ASOF LEFT JOIN u ON l.user_id = u.user_id AND l.ts > u.ts ASOF LEFT JOIN i ON l.item_id = i.item_id AND l.ts > i.ts"""
)
def training_set_as_of(spark, sf):
    return models.training_set_as_of(t.events(spark, sf)).withColumn("ctr", F.round("ctr", 6)).drop("ts")


_HELD = f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n,
      count(*) OVER (PARTITION BY user_id) AS total FROM ev),
    held AS (SELECT user_id, item_id FROM r WHERE n = 1 AND total > 1),
    score AS (SELECT item_id, sum({WEIGHT})::DOUBLE AS score FROM r WHERE NOT (n = 1 AND total > 1) GROUP BY 1)"""
_MEASURE = """count(*) AS users, count(rank)::BIGINT AS hits, round(count(rank) / count(*), 6) AS recall,
      round(sum(CASE WHEN rank IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) / count(*), 6) AS ndcg"""


def _rounded(measure):
    return measure.withColumns({c: F.round(c, 6) for c in ("recall", "ndcg")})


@query(
    f"""{_HELD}, best AS (SELECT row_number() OVER (ORDER BY score DESC, item_id) AS rank, item_id FROM score ORDER BY rank LIMIT 20)
    SELECT {_MEASURE} FROM held LEFT JOIN best USING (item_id)"""
)
def popular_holdout(spark, sf):
    """How well the most popular items of all other events name every user's newest one."""
    rest, held = evaluate.leave_last_out(t.events(spark, sf))
    return _rounded(evaluate.popular_measure(ranking.popular_items(rest, 20), held, 20))


@query(
    f"""{_HELD}, own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY sum({WEIGHT}) DESC, item_id) AS rank
      FROM r WHERE NOT (n = 1 AND total > 1) GROUP BY 1, 2 HAVING sum({WEIGHT}) > 0)
    SELECT {_MEASURE} FROM held LEFT JOIN (SELECT * FROM own WHERE rank <= 20) USING (user_id, item_id)"""
)
def history_holdout(spark, sf):
    """How well the items a user had most to do with before name the newest one."""
    rest, held = evaluate.leave_last_out(t.events(spark, sf))
    own = strengths(rest).withColumnRenamed("strength", "score")
    return _rounded(evaluate.ranking_measure(ranking.top_k(own, 20), held, 20))


@query()
def als_topk(spark, sf):
    users, items = models.learn_vectors(strengths(t.events(spark, sf)), rank=16)
    return nearest.nearest_items(users, items, 10, digits=6)


@query(
    f"""WITH {EV}, s AS (SELECT user_id, item_id, sum({WEIGHT})::DOUBLE AS strength FROM ev GROUP BY 1, 2
                         HAVING strength > 0),
    parts AS (SELECT user_id, strength, pos, embedding[pos]::DOUBLE AS x
              FROM s JOIN embeddings ON vec_id::VARCHAR = item_id, range(1, 65) r(pos))
    SELECT user_id, (pos - 1)::INT AS pos, round(sum(strength * x) / sum(strength), 4) + 0.0 AS x FROM parts GROUP BY 1, 2"""
)
def blended_vectors(spark, sf):
    vectors = t.item_vectors(spark, sf).withColumn("item_id", F.col("item_id").cast("string"))
    blended = blend_vectors(strengths(t.events(spark, sf)), vectors)
    flat = blended.select("user_id", F.posexplode("embedding").alias("pos", "x"))
    return flat.withColumn("x", F.round(F.col("x").cast("double"), 4))


def _id_vectors(spark, sf, key):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("id_vector"))


@query()
def tower_user_vectors(spark, sf):
    """User tower over all buyers; their history is the sizes of the parts they bought."""
    sizes = t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("category_idx"))
    trades = t.trade_events(spark, sf).join(sizes, "item_id")
    hists = trades.groupBy("user_id").agg(F.sort_array(F.collect_set("category_idx")).alias("category_hist"))
    ready = models.with_id_vectors(hists, _id_vectors(spark, sf, "user_id"), "user_id")
    return _summary(models.embed_users(ready, models.new_tower(64, False, seed=1)), "user_id")


@query()
def tower_item_vectors(spark, sf):
    """Item tower over the whole catalog."""
    parts = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_size").alias("category_idx"),
        (F.col("p_retailprice") / 1000).alias("price"),
    )
    ready = models.with_id_vectors(parts, _id_vectors(spark, sf, "item_id"), "item_id")
    return _summary(models.embed_items(ready, models.new_tower(64, True, seed=2)), "item_id")


def _summary(vectors, key):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select(key, F.size("embedding").alias("dim"), F.round(total, 3).alias("squares"))


def _followable(with_price: bool) -> models.Tower:
    """Weights that SQL can follow: (x, category + price + 2 max(x, 0) + 1), x the first number of the id vector."""
    n = models.ID_DIM
    inner = np.zeros((n + 1 + with_price, 3))
    inner[0, 0], inner[0, 1], inner[n:, 2] = 1, -1, 1
    outer = np.array([[1.0, 2.0], [-1.0, 0.0], [0.0, 1.0]])
    layers = models.Dense(inner, np.zeros(3), relu=True), models.Dense(outer, np.array([0.0, 1.0]))
    price = models.Dense(np.array([[0.5]]), np.array([0.25])) if with_price else None
    return models.Tower(layers, np.arange(64.0)[:, None], price)


def _pair(vectors, key):
    x, y = (F.round(F.col("embedding")[i].cast("double"), 5) for i in (0, 1))
    return vectors.select(key, F.size("embedding").alias("dim"), x.alias("x"), y.alias("y"))


@query(
    f"""WITH {TRADES}, h AS (SELECT user_id, sum(DISTINCT p_size) AS total, count(DISTINCT p_size) AS n
      FROM trades JOIN part ON item_id = p_partkey GROUP BY 1),
    v AS (SELECT h.*, coalesce(embedding[1]::DOUBLE, 0) AS x FROM h LEFT JOIN embeddings ON vec_id = user_id)
    SELECT user_id, 2 AS dim, round(x::FLOAT::DOUBLE, 5) + 0.0 AS x,
      round((total / greatest(n, 5) + 2 * greatest(x, 0) + 1)::FLOAT::DOUBLE, 5) AS y FROM v"""
)
def tower_user_followed(spark, sf):
    """User tower with weights that SQL can follow; short histories are padded with category 0."""
    sizes = t.table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("category_idx"))
    trades = t.trade_events(spark, sf).join(sizes, "item_id")
    hists = trades.groupBy("user_id").agg(F.sort_array(F.collect_set("category_idx")).alias("category_hist"))
    ready = models.with_id_vectors(hists, _id_vectors(spark, sf, "user_id"), "user_id")
    return _pair(models.embed_users(ready, _followable(False)), "user_id")


@query(
    """WITH v AS (SELECT p_partkey AS item_id, p_size, p_retailprice, coalesce(embedding[1]::DOUBLE, 0) AS x
      FROM part LEFT JOIN embeddings ON vec_id = p_partkey)
    SELECT item_id, 2 AS dim, round(x::FLOAT::DOUBLE, 5) + 0.0 AS x,
      round((p_size + (p_retailprice / 1000 * 0.5 + 0.25) + 2 * greatest(x, 0) + 1)::FLOAT::DOUBLE, 5) AS y FROM v"""
)
def tower_item_followed(spark, sf):
    """Item tower with weights that SQL can follow."""
    parts = t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_size").alias("category_idx"), (F.col("p_retailprice") / 1000).alias("price")
    )
    ready = models.with_id_vectors(parts, _id_vectors(spark, sf, "item_id"), "item_id")
    return _pair(models.embed_items(ready, _followable(True)), "item_id")


@query()
def cross_network_scores(spark, sf):
    """Ranking model over every pair of buyer and bought part."""
    pairs = t.trade_events(spark, sf).select("user_id", "item_id").distinct()
    vectors = t.item_vectors(spark, sf)
    ranker = models.model_ranker(
        vectors.withColumnRenamed("item_id", "user_id"), vectors,
        models.new_cross_network((64, 64, 32), cross_layers=2, deep=(64, 32), seed=3),
    )
    return ranker(pairs).withColumn("model_score", F.round("model_score", 6))


@query(
    f"""WITH {TRADES}, pairs AS (SELECT DISTINCT user_id, item_id FROM trades)
    SELECT user_id, item_id, round(1 / (1 + exp(-coalesce({_DOT.format('u.embedding', 'i.embedding')}, 0))), 6)
      AS model_score
    FROM pairs LEFT JOIN embeddings u ON u.vec_id = user_id LEFT JOIN embeddings i ON i.vec_id = item_id"""
)
def cross_network_dot(spark, sf):
    """Ranking model with weights chosen so that it gives the sigmoid of an inner product."""
    pairs = t.trade_events(spark, sf).select("user_id", "item_id").distinct()
    vectors = t.item_vectors(spark, sf)
    n = 64
    swap = np.zeros((2 * n + 1, 2 * n + 1))
    swap[n : 2 * n, :n] = np.eye(n)  # pairs each user entry with its item entry
    cross = models.Cross(swap[None], np.zeros(2 * n + 1))
    deep = models.Dense(np.zeros((2 * n + 1, 1)), np.zeros(1), relu=True)
    weights = np.zeros((2 * n + 2, 1))
    weights[:n] = 1.0
    # one layer gives x0 * (x0 @ swap) + x0; subtract the residual through the deep part
    residual = np.zeros((2 * n + 1, 2))
    residual[:n, 0], residual[:n, 1] = 1.0, -1.0
    deep = models.Dense(residual, np.zeros(2), relu=True)
    out = models.Dense(np.concatenate([weights[: 2 * n + 1], [[-1.0], [1.0]]]), np.zeros(1))
    net = models.CrossNetwork((cross,), (deep,), out, (n, n, 1))
    ranker = models.model_ranker(vectors.withColumnRenamed("item_id", "user_id"), vectors, net)
    return ranker(pairs).withColumn("model_score", F.round("model_score", 6))
