"""Values as they stood at an instant: as-of joins and running sums, cut along time.

Both work in ``(key, time bucket)`` groups and carry one row per bucket from bucket to bucket, so
that a hot key is many small tasks and what is gathered per key is one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.operators.skew import content_hash

DAY = 86_400


def _bucket(ts: Column, width_seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(width_seconds))


def running_sums(df: DataFrame, key: str, sums: dict[str, Column], ts: str = "ts", width_seconds: int = DAY) -> DataFrame:
    """``(key, ts, …)``: the named sums over all rows of the key up to and including each of its instants.

    ``sums`` are aggregates that add up (sums, counts). Rows without key or instant take no part.
    Rows of one instant fold to one before anything is sorted.
    """
    known = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    folded = known.groupBy(key, ts).agg(*[c.alias(n) for n, c in sums.items()]).withColumn("_bucket", _bucket(F.col(ts), width_seconds))
    totals = folded.groupBy(key, "_bucket").agg(*[F.sum(n).alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_bucket", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy(key, "_bucket").orderBy(ts)
    inside = folded.select(key, ts, "_bucket", *[F.sum(n).over(within).alias(n) for n in sums])
    return inside.join(carried, [key, "_bucket"]).select(key, ts, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def asof_join(
    left: DataFrame, right: DataFrame, key: str, values: list[str], ts: str = "ts", strict: bool = True, width_seconds: int = DAY
) -> DataFrame:
    """Every left row with the ``values`` of the key's newest right row before it (``strict``), or not after it.

    Both sides have ``key`` and ``ts``. Of right rows of one instant the one with the greatest values counts.
    Left rows without key or instant, and those with nothing before them, get nulls. Left columns named like one of ``values``
    are replaced. The rows of both sides are sorted together in their bucket; a row with nothing before it
    there takes the last values of the nearest earlier bucket that has any.
    """
    kept = [c for c in left.columns if c not in values]
    at = F.col("_at")
    ours = left.select(
        F.struct(*kept).alias("_left"), F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(0 if strict else 1).alias("_side"),
        # rows that meet nothing are spread by their content
        F.when(F.col(key).isNull() | F.col(ts).isNull(), content_hash(left, key)).otherwise(F.lit(0)).alias("_spread"),
    )
    theirs = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"),
        F.lit(0).cast("bigint").alias("_spread"), F.struct(*values).alias("_right"),
    )
    both = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_bucket", _bucket(at, width_seconds))

    newest = F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_at", "_right")))
    ends = both.where(F.col("_key").isNotNull() & at.isNotNull()).groupBy("_key", "_bucket").agg(newest.alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_bucket", F.lit(0).cast("bigint").alias("_spread"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))

    place = ["_key", "_bucket", "_spread"]
    so_far = Window.partitionBy(*place).orderBy("_at", "_side", "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_found", F.last("_right", ignorenulls=True).over(so_far)).where(F.col("_left").isNotNull())
    value = F.coalesce("_found", "_carried")
    return inside.join(carried, place, "left").withColumn("_value", value).select("_left.*", *[F.col("_value")[v].alias(v) for v in values])
