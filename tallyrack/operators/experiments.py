"""Experiment assignment by traffic share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.functions.hashing import fnv1a_bucket

BUCKETS = 100
CONTROL = "control"


def traffic_ranges(experiments: DataFrame) -> DataFrame:
    """Running share per experiment in id order: it takes buckets ``[lo, hi)``."""
    order = Window.orderBy("experiment_id")  # a configuration table: a handful of rows
    to_here = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return experiments.withColumn("hi", F.sum("traffic_pct").over(to_here)).withColumn(
        "lo", F.col("hi") - F.col("traffic_pct")
    )


def bucket_map(experiments: DataFrame) -> DataFrame:
    """Bucket -> the first experiment whose running share is above it: 100 rows at most."""
    ranges = traffic_ranges(experiments)
    buckets = ranges.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket")
    ).where(F.col("bucket") < F.col("hi"))
    first = F.min_by(F.struct("experiment_id", "model_version"), F.col("experiment_id"))
    return buckets.groupBy("bucket").agg(first.alias("arm")).select("bucket", "arm.*")


def assign_experiments(users: DataFrame, experiments: DataFrame) -> DataFrame:
    """Add ``bucket``, ``experiment_id`` and ``model_version``; null = control group.

    The range match becomes an equi join on the bucket, against 100 rows at most.
    """
    hashed = users.withColumn("bucket", fnv1a_bucket(F.col("user_id")))
    return hashed.join(F.broadcast(bucket_map(experiments)), "bucket", "left")


def experiment_split(assigned: DataFrame) -> DataFrame:
    """Users and share per arm."""
    arm = F.coalesce(F.col("experiment_id"), F.lit(CONTROL))
    counts = assigned.groupBy(arm.alias("arm")).agg(F.count("*").alias("users"))
    total = F.sum("users").over(Window.partitionBy())  # one row per arm
    return counts.withColumn("share", F.col("users") / total)


def active_experiments(active: DataFrame, configs: DataFrame) -> DataFrame:
    """``configs(experiment_id, value)`` as JSON -> columns, for the active ids only.

    Missing and unreadable configurations are skipped.
    """
    from tallyrack.functions.jsonio import experiment_from_json

    config = F.col("config")
    return (
        configs.join(active.select("experiment_id").distinct(), "experiment_id", "left_semi")
        .withColumn("config", experiment_from_json(F.col("value")))
        .where(config["id"].isNotNull())
        .select(
            config["id"].alias("experiment_id"),
            config["model_version"].alias("model_version"),
            F.coalesce(config["traffic_pct"], F.lit(0.0)).alias("traffic_pct"),
            F.coalesce(config["tier_config"], F.lit("")).alias("tier_config"),
        )
    )


def check_experiments(experiments: DataFrame) -> DataFrame:
    """Ranges that are empty, start at or run beyond 100 %."""
    problem = (
        F.when(F.col("traffic_pct") <= 0, "no traffic")
        .when(F.col("lo") >= BUCKETS, "never reached")
        .when(F.col("hi") > BUCKETS, "cut off")
    )
    return traffic_ranges(experiments).withColumn("problem", problem)


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Experiments whose declared ``[lo, hi)`` overlaps one that starts before."""
    before = Window.orderBy("lo", "experiment_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("hi").over(before)  # a configuration table: a handful of rows
    return ranges.withColumn("overlaps", F.coalesce(F.col("lo") < reach, F.lit(False)))


def exposures(assigned: DataFrame) -> DataFrame:
    """Exposure log rows of the users in an experiment; works on batches and streams."""
    return assigned.where(F.col("experiment_id").isNotNull()).select(
        "user_id", "experiment_id", "model_version", "ts"
    )
