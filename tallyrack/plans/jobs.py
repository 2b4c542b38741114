"""Daily and four-hourly batch jobs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.operators import features as feat
from tallyrack.operators.models import learn_vectors
from tallyrack.operators.nearest import nearest_items
from tallyrack.operators.quality import Rule, quality
from tallyrack.operators.skew import salted_join
from tallyrack.sources import cache
from tallyrack.sources.events import read_day, read_slice, read_slices, stored_batches, take_slice, write_counted, write_partition

#: How much an interaction counts: the weights of the popularity ranking.
STRENGTH = feat.POPULARITY_WEIGHTS


@dataclass(frozen=True)
class Paths:
    """Folders of the jobs. Every run writes below its own name and reads the run before.

    A run leaves all that the next one reads: features, pair counts, user and item vectors, lists.
    ``cache`` gets the lists as JSON per user; by default it lies beside ``recs``. ``slices`` keeps the
    cursor over the lake and the events each run took; by default it lies beside ``features``.
    """

    events: str
    features: str
    vectors: str
    recs: str
    cache: str | None = None
    slices: str | None = None

    def lists(self, run: str) -> str:
        return f"{self.cache or self.recs + '_json'}/{run}"

    def taken(self, run: str) -> str:
        """Where a run's slice lies; a run that is repeated finds it again."""
        return f"{self.slices or self.features + '_slices'}/{run}"

    @property
    def cursor(self) -> str:
        return f"{self.slices or self.features + '_slices'}/_cursor"


def strengths(events: DataFrame) -> DataFrame:
    """``(user_id, item_id, strength)`` of the interactions that count."""
    weight = F.lit(0.0)
    for event_type, value in STRENGTH.items():
        weight = F.when(F.col("event_type") == event_type, value).otherwise(weight)
    return events.groupBy("user_id", "item_id").agg(F.sum(weight).alias("strength")).where("strength > 0")


def blend_vectors(liked: DataFrame, items: DataFrame) -> DataFrame:
    """User vectors as the strength-weighted mean of the item vectors they interacted with."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = items.select("item_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    # whole vectors fold to a running mean before the shuffle
    mean = Summarizer.mean(F.col("v"), F.col("strength"))
    means = salted_join(liked, vectors, "item_id", "inner").groupBy("user_id").agg(mean.alias("v"))
    return means.select("user_id", vector_to_array("v", "float32").alias("embedding"))


def _write_features(events: DataFrame, paths: Paths, run: str) -> dict:
    users = write_counted(
        feat.compute_user_features(events), f"{paths.features}/user/{run}", metrics={"users": F.count(F.lit(1))}
    )
    pairs = feat.item_user_counts(events)
    write_partition(pairs, f"{paths.features}/item_user/{run}")
    stored = events.sparkSession.read.parquet(f"{paths.features}/item_user/{run}")
    items = write_counted(
        feat.item_features_from_counts(stored), f"{paths.features}/item/{run}", metrics={"items": F.count(F.lit(1))}
    )
    return {**users, **items}


FEATURE_RULES = [
    Rule("user_id", "not_null"),
    Rule("total_events", "range", low=1),
    Rule("total_clicks", "range", low=0),
]


def daily_full(
    spark: SparkSession, ds: str, paths: Paths, k: int = 100, rank: int = 16, method: str = "bounded"
) -> dict:
    """Features, vectors and top-K of one day; returns what was written."""
    day = dt.date.fromisoformat(ds)
    run = f"date={ds}"
    events = read_day(spark, paths.events, day)
    out = _write_features(events, paths, run)
    users = spark.read.parquet(f"{paths.features}/user/{run}")
    failed = quality(users, FEATURE_RULES).agg(F.sum("failed")).first()[0]
    if failed:
        raise ValueError(f"{failed} user feature rows fail their checks")
    liked = strengths(events)
    write_partition(liked, f"{paths.features}/strength/{run}")
    liked = spark.read.parquet(f"{paths.features}/strength/{run}")  # learning reads it several times
    user_vectors, item_vectors = learn_vectors(liked, rank=rank)
    write_partition(user_vectors, f"{paths.vectors}/user/{run}")
    write_partition(item_vectors, f"{paths.vectors}/item/{run}")
    best = nearest_items(
        spark.read.parquet(f"{paths.vectors}/user/{run}"),
        spark.read.parquet(f"{paths.vectors}/item/{run}"),
        k,
        method,
    )
    as_of = F.lit(dt.datetime.combine(day + dt.timedelta(days=1), dt.time()))
    expiring = best.withColumn("expires_at", cache.after(as_of, cache.FULL_TTL))
    out.update(write_counted(expiring, f"{paths.recs}/{run}", metrics={"recommendations": F.count(F.lit(1))}))
    write_partition(cache.lists_to_cache(spark.read.parquet(f"{paths.recs}/{run}")), paths.lists(run))
    return out


def set_cursor(spark: SparkSession, paths: Paths, run: str) -> None:
    """Take all that the lake holds now as read: for the full run that the next slices build on."""
    take_slice(spark, paths.events, paths.taken(run), paths.cursor)


def _arrived(spark: SparkSession, paths: Paths, run: str) -> DataFrame:
    """The run's slice: what has come since the last run; taken once, however often the run is repeated."""
    done = f"{paths.taken(run)}_done"
    try:
        numbers = [r["number"] for r in spark.read.parquet(done).collect()]
    except AnalysisException:  # the run's first try, or one that broke off before all was stored
        take_slice(spark, paths.events, paths.taken(run), paths.cursor)
        numbers = stored_batches(spark, paths.taken(run))
        spark.createDataFrame([(n,) for n in numbers], "number bigint").write.mode("overwrite").parquet(done)
    return read_slices(spark, paths.taken(run), numbers)


def incremental_4h(
    spark: SparkSession, now: dt.datetime, paths: Paths, base: str, run: str, k: int = 100, method: str = "bounded",
    arrived: bool = False,
) -> dict:
    """Refresh the users of the last four hours on top of the run ``base``.

    With ``arrived`` the slice is not the last four hours of event time but all that has come to the
    lake since the run before (``set_cursor`` after the full run): late events are in the next run, exactly
    once. Stored features take in the new events; the users seen get a new vector from the stored
    item vectors and a new list; all other lists stay until they expire. The run writes all that
    the next run reads, so runs follow one another within a day. ``without_vector`` counts the
    users seen who only touched items that have no vector yet: their old list stays.
    """
    events = _arrived(spark, paths, run) if arrived else read_slice(spark, paths.events, now)
    old_users = spark.read.parquet(f"{paths.features}/user/{base}")
    old_pairs = spark.read.parquet(f"{paths.features}/item_user/{base}")
    merged = feat.merge_user_features(old_users, feat.compute_user_features(events))
    out = write_counted(merged, f"{paths.features}/user/{run}", metrics={"users": F.count(F.lit(1))})
    pairs = feat.merge_item_counts(old_pairs, feat.item_user_counts(events))
    write_partition(pairs, f"{paths.features}/item_user/{run}")
    stored = spark.read.parquet(f"{paths.features}/item_user/{run}")
    write_partition(feat.item_features_from_counts(stored), f"{paths.features}/item/{run}")
    liked = stored.select("user_id", "item_id", feat.strength_of_counts().alias("strength")).where("strength > 0")
    item_vectors = spark.read.parquet(f"{paths.vectors}/item/{base}")
    write_partition(item_vectors, f"{paths.vectors}/item/{run}")
    seen = feat.affected(liked, events)
    vectors = blend_vectors(seen, item_vectors)
    out.update(
        write_counted(vectors, f"{paths.vectors}/changed/{run}", metrics={"affected_users": F.count(F.lit(1))})
    )
    changed = spark.read.parquet(f"{paths.vectors}/changed/{run}")
    out["without_vector"] = seen.select("user_id").distinct().join(changed, "user_id", "left_anti").count()
    old_vectors = spark.read.parquet(f"{paths.vectors}/user/{base}").select(*changed.columns)
    write_partition(feat.merge_recs(old_vectors, changed), f"{paths.vectors}/user/{run}")
    refreshed = nearest_items(changed, item_vectors, k, method)
    expiring = refreshed.withColumn("expires_at", cache.after(F.lit(now), cache.INCREMENTAL_TTL))
    old = cache.expire(spark.read.parquet(f"{paths.recs}/{base}"), F.lit(now))
    out.update(
        write_counted(
            feat.merge_recs(old, expiring), f"{paths.recs}/{run}", metrics={"recommendations": F.count(F.lit(1))}
        )
    )
    write_partition(cache.lists_to_cache(spark.read.parquet(f"{paths.recs}/{run}")), paths.lists(run))
    return out
