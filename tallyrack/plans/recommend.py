"""The request cascade as one plan over a request table.

Per request: cached list, else popular items; drop what is out of stock; re-rank by session;
rank misses by model; cut to the limit. A list has 100 entries at most and a session counts 50
events, so lists stay arrays on the request row, and the request table is shuffled once for
its user and once for its session, never per candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.functions.rules import (
    MAX_LIMIT,
    Weights,
    adjusted_score,
    effective_limit,
    load_level,
    tier_allowed,
)
from tallyrack.operators.experiments import assign_experiments
from tallyrack.operators.ranking import pack_popular
from tallyrack.operators.sessions import session_buffer, session_features
from tallyrack.operators.skew import HOT_ROWS, salted_join
from tallyrack.operators.stock import blocked_items, probe_stock
from tallyrack.session import cut_lineage
from tallyrack.sources.cache import expire

# The labels of the answering tier.
TIER1, TIER2, TIER3 = "tier1_precomputed", "tier2_rerank", "tier3_inference"
FALLBACK, POPULAR = "fallback_popular", "tier0_popular"

Ranker = Callable[[DataFrame], DataFrame]

#: Candidates that a ``ListRanker`` scores at once; each brings two vectors.
_SCORED_ROWS = 32_768


@dataclass(frozen=True)
class ListRanker:
    """A model that scores a request's whole list at once, without a row per candidate.

    ``users(user_id, embedding)`` and ``items(item_id, embedding)`` hold vectors of ``dim`` numbers; a
    missing one counts as zeros. ``score`` takes two matrices, row against row, and returns their
    scores; one that is no number means that the model failed, and the request keeps its list.
    """

    users: DataFrame
    items: DataFrame
    dim: int
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _prepared(requests: DataFrame) -> DataFrame:
    """Requests with usable limit, load level and a null for an empty session."""
    columns = requests.columns
    session = F.col("session_id").cast("string") if "session_id" in columns else F.lit(None).cast("string")
    limit = F.col("limit").cast("string") if "limit" in columns else F.lit(None).cast("string")
    ratio = F.col("load_ratio") if "load_ratio" in columns else F.lit(None).cast("double")
    return requests.select(
        "request_id",
        "user_id",
        F.nullif(session, F.lit("")).alias("session_id"),
        effective_limit(limit).alias("effective_limit"),
        load_level(ratio).alias("load_level"),
    )


def _cached_lists(recs: DataFrame, users: DataFrame, stock: DataFrame) -> DataFrame:
    """In-stock cached entries per requested user; an empty array is still a hit."""
    wanted = recs.join(users, "user_id", "left_semi").select("user_id", "rank", "item_id", "score")
    known = probe_stock(wanted, stock)
    entry = F.struct("rank", "item_id", "score")
    return known.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("out_of_stock"), entry))).alias("cached")
    )


def _popular_list(popular: DataFrame, stock: DataFrame) -> DataFrame:
    """One row with the popular entries and their stock status."""
    top = popular.where(F.col("rank") <= MAX_LIMIT).select("rank", "item_id", "score")
    names = F.broadcast(top.select("item_id"))  # MAX_LIMIT rows
    gone = blocked_items(stock).join(names, "item_id", "left_semi").withColumn("out", F.lit(True))
    flagged = top.join(F.broadcast(gone), "item_id", "left").fillna({"out": False})
    return pack_popular(flagged, MAX_LIMIT)


def _reranked(items: Column, weights: Weights) -> Column:
    """Adjusted scores, best first; equal scores keep their order."""

    def entry(x: Column) -> Column:
        clicked = F.coalesce(F.array_contains(F.col("clicked"), x["item_id"]), F.lit(False))
        viewed = F.coalesce(F.array_contains(F.col("viewed"), x["item_id"]), F.lit(False))
        score = adjusted_score(x["score"], clicked, viewed, weights)
        return F.struct((-score).alias("o"), x["rank"].alias("rank"), x["item_id"].alias("item_id"), score.alias("score"))

    return F.transform(F.sort_array(F.transform(items, entry)), _plain)


def _plain(x: Column) -> Column:
    return F.struct(x["item_id"].alias("item_id"), x["score"].alias("score"))


def recommend(
    requests: DataFrame,
    recs: DataFrame,
    popular: DataFrame,
    stock: DataFrame,
    session_events: DataFrame | None = None,
    ranker: Ranker | ListRanker | None = None,
    weights: Weights = Weights(),
    hot_rows: int = HOT_ROWS,
    as_of: Column | None = None,
) -> DataFrame:
    """Answer requests: ``(request_id, user_id, session_id, load_level, tier, items)``.

    ``requests(request_id, user_id, session_id, limit, load_ratio)``; ``recs`` and ``popular``
    are top-K tables; ``stock(item_id, bit_offset, out_of_stock)``. Without ``session_events``
    nothing is re-ranked; without ``ranker`` misses are not ranked by model. A ranker takes
    ``(request_id, user_id, item_id, …)`` rows and adds ``model_score``; a null score means it
    failed, and the request keeps its popular list. A ``ListRanker`` works on the lists as they are:
    one shuffle by user brings the user's vector, and no candidate becomes a row. With ``as_of``, lists whose ``expires_at`` has
    passed and sessions that have ended by then are gone.
    """
    asked = _prepared(requests)
    # MAX_LIMIT rows, which several steps read
    popular = requests.sparkSession.createDataFrame(popular.where(F.col("rank") <= MAX_LIMIT).collect(), popular.schema)
    if as_of is not None and "expires_at" in recs.columns:
        recs = expire(recs, as_of)
    users = asked.where(F.col("load_level") != "emergency").select("user_id").distinct()
    rows = salted_join(asked, _cached_lists(recs, users, stock), "user_id", "left", hot_rows, hot_from=asked)
    if session_events is None:
        rows = rows.withColumn("clicked", F.lit(None).cast("array<string>")).withColumn("viewed", F.col("clicked"))
    else:
        # only the sessions of these requests are aggregated
        wanted = asked.where(F.col("session_id").isNotNull()).select("session_id").distinct()
        named = session_events.withColumn("session_id", F.col("session_id").cast("string"))
        own = named.join(wanted, "session_id", "left_semi")
        if as_of is not None:
            own = session_buffer(own, as_of)
        seen = session_features(own).select(
            F.col("session_id").cast("string").alias("session_id"), "clicked", "viewed"
        )
        rows = salted_join(rows, seen, "session_id", "left", hot_rows, hot_from=asked)
    rows = (
        rows.withColumn("one", F.lit(1))
        .join(F.broadcast(_popular_list(popular, stock)), "one", "left")  # a single row
        .drop("one")
    )
    level, limit = F.col("load_level"), F.col("effective_limit")
    emergency = ~tier_allowed(level, "tier1")
    miss = F.col("cached").isNull()
    rerank = F.lit(session_events is not None) & F.col("session_id").isNotNull() & tier_allowed(level, "tier2")
    top = F.filter("popular", lambda x: x["rank"] <= limit)
    available = F.transform(
        F.filter(top, lambda x: ~x["out"]),
        lambda x: F.struct(x["rank"].alias("rank"), x["item_id"].alias("item_id"), x["score"].alias("score")),
    )
    candidates = F.when(miss, available).otherwise(F.col("cached"))
    items = (
        F.when(emergency, F.transform(top, _plain))
        .when(rerank, _reranked(F.col("candidates"), weights))
        .otherwise(F.transform(F.col("candidates"), _plain))
    )
    tier = F.when(emergency | miss, FALLBACK).when(rerank, TIER2).otherwise(TIER1)
    kept = ["request_id", "user_id", "session_id", "load_level"]
    none = F.filter(F.array(F.struct(F.lit("").alias("item_id"), F.lit(0.0).alias("score"))), lambda x: F.lit(False))
    answered = rows.withColumn("candidates", candidates).select(
        *kept,
        (miss & tier_allowed(level, "tier3")).alias("wants_model"),
        tier.alias("tier"),
        # the model sees no list longer than the limit, so the cut may come first
        F.slice(F.coalesce(items, none), 1, limit).alias("items"),
    )
    if ranker is None:
        return answered.drop("wants_model")
    if isinstance(ranker, ListRanker):
        return _ranked_in_lists(answered, popular, ranker, hot_rows, asked.select(F.col("user_id").alias("_user")))
    # written out once: the model branch reads its rows several times
    answered = cut_lineage(answered)
    ranked = _ranked(answered.where("wants_model").drop("wants_model"), ranker, kept)
    return answered.where(~F.col("wants_model")).drop("wants_model").unionByName(ranked)


def _ranked_in_lists(answered: DataFrame, popular: DataFrame, ranker: ListRanker, hot_rows: int, users: DataFrame) -> DataFrame:
    """Lists of the requests that want the model, in its order; the other rows pass unchanged.

    ``users`` (``_user``) are those of all requests, so that busy ones are counted on a plain table. A model's candidates all come from the popular list, so the item vectors are MAX_LIMIT at most
    and travel with the tasks.
    """
    names = popular.where(F.col("rank") <= MAX_LIMIT).select("item_id")
    known = ranker.items.join(F.broadcast(names), "item_id", "left_semi").select("item_id", "embedding").collect()
    places = {row["item_id"]: i for i, row in enumerate(known)}
    vectors = np.zeros((len(known) + 1, ranker.dim))  # the last row stands for an unknown item
    for row in known:
        if row["embedding"] is not None:
            vectors[places[row["item_id"]]] = row["embedding"]
    dim, score = ranker.dim, ranker.score
    sides = ranker.users.select(F.col("user_id").alias("_user"), F.col("embedding").cast("array<double>").alias("_vector"))
    rows = answered.withColumn("_user", F.when(F.col("wants_model"), F.col("user_id")))
    rows = salted_join(rows, sides, "_user", "left", hot_rows, hot_from=users).select(
        F.struct(*answered.columns).alias("row"),
        F.when(F.col("wants_model"), F.transform("items", lambda x: x["item_id"])).alias("ids"),
        "_vector",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _SCORED_ROWS // MAX_LIMIT)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                lists, own = batch.column("ids").to_pylist(), batch.column("_vector").to_pylist()
                size = np.array([len(x or ()) for x in lists], dtype=np.int64)
                at = np.array([places.get(i, len(places)) for x in lists for i in x or ()], dtype=np.int64)
                users = np.array([v or [0.0] * dim for v in own], dtype=np.float64).reshape(len(own), dim)
                scores = score(np.repeat(users, size, axis=0), vectors[at]) if len(at) else np.zeros(0)
                ends = np.r_[0, np.cumsum(size)].astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(scores, pa.float64()))
                yield pa.record_batch([batch.column("row"), column], names=["row", "scores"])

    kind = answered.schema.simpleString()
    scored = rows.mapInArrow(run, f"row {kind}, scores array<double>").select("row.*", "scores")
    entry = lambda x, i: F.struct(
        (-F.get("scores", i)).alias("o"), i.alias("pos"), x["item_id"].alias("item_id"), F.get("scores", i).alias("score")
    )
    failed = F.exists("scores", lambda s: F.isnan(s))
    by_model = F.transform(F.sort_array(F.transform("items", entry)), _plain)
    ranks = F.col("wants_model") & ~failed
    return scored.withColumn("items", F.when(ranks, by_model).otherwise(F.col("items"))).withColumn(
        "tier", F.when(ranks, TIER3).when(F.col("wants_model"), FALLBACK).otherwise(F.col("tier"))
    ).drop("wants_model", "scores")


def _ranked(misses: DataFrame, ranker: Ranker, kept: list[str]) -> DataFrame:
    """Misses with their list ordered by the model; ties keep their order."""
    # spread while the lists are still packed: the unpacked rows of a request stay in one
    # task, which packs them again before the next shuffle
    placed = misses.repartition("request_id")
    flat = placed.select(*kept, F.posexplode_outer("items").alias("pos", "item")).select(
        *kept, "pos", "item.item_id", "item.score"
    )
    scored = ranker(flat)
    there = F.col("item_id").isNotNull()
    by_model = F.struct(
        (-F.col("model_score")).alias("o"), "pos", "item_id", F.col("model_score").alias("score")
    )
    before = F.struct("pos", "item_id", "score")
    grouped = scored.groupBy("request_id").agg(
        *[F.any_value(c).alias(c) for c in kept if c != "request_id"],
        F.coalesce(F.bool_or(there & F.col("model_score").isNull()), F.lit(False)).alias("failed"),
        F.sort_array(F.collect_list(F.when(there, by_model))).alias("by_model"),
        F.sort_array(F.collect_list(F.when(there, before))).alias("before"),
    )
    items = F.when(F.col("failed"), F.transform("before", _plain)).otherwise(F.transform("by_model", _plain))
    return grouped.select(
        *kept, F.when(F.col("failed"), FALLBACK).otherwise(TIER3).alias("tier"), items.alias("items")
    )


def recommendation_rows(answers: DataFrame) -> DataFrame:
    """Answers -> one row per recommended item."""
    flat = answers.select("request_id", "tier", F.posexplode("items").alias("pos", "item"))
    return flat.select("request_id", (F.col("pos") + 1).alias("rank"), "item.item_id", "item.score", "tier")


def responses(answers: DataFrame, experiments: DataFrame | None = None) -> DataFrame:
    """Answers with their experiment arm and the JSON body; no items give an empty list."""
    if experiments is None:
        arms = answers.withColumn("experiment_id", F.lit(None).cast("string"))
        arms = arms.withColumn("model_version", F.lit(None).cast("string"))
    else:
        arms = assign_experiments(answers, experiments)
    body = F.to_json(F.struct("items", "tier", "experiment_id", "model_version"))
    return arms.withColumn("body", body)


def popular_responses(requests: DataFrame, popular: DataFrame) -> DataFrame:
    """Answers of the popular endpoint: the list up to the request limit."""
    from tallyrack.operators.ranking import popular_for_limits

    asked = requests.select("request_id", effective_limit(F.col("limit").cast("string")).alias("effective_limit"))
    listed = popular_for_limits(asked, popular)
    return listed.withColumn("tier", F.lit(POPULAR)).withColumn("items", F.transform("items", _plain))
