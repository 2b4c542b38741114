"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.session import cut_lineage

#: Rows of one key that one task may take before the key is split.
HOT_ROWS = 1_000_000
#: Fewer keys than this are split: a key must also hold more than this part of all rows.
HOT_KEYS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, parts)`` of the keys to split, with a part for every ``hot_rows`` rows.

    A key is split if it has more than ``hot_rows`` rows and more than 1/HOT_KEYS of all rows, so
    there are fewer than ``HOT_KEYS`` of them at any size, and the part counts have no limit.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("key_rows"))
    total = counts.agg(F.sum("key_rows").alias("rows")).withColumn("one", F.lit(1))
    known = counts.where(F.col("key_rows") > hot_rows).withColumn("one", F.lit(1))
    large = known.join(F.broadcast(total), "one")  # a single row
    return large.where(F.col("key_rows") * HOT_KEYS > F.col("rows")).select(
        key, F.ceil(F.col("key_rows") / F.lit(hot_rows)).cast("int").alias("parts")
    )


def _plain_columns(df: DataFrame, key: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name != key and isinstance(f.dataType, T.AtomicType)]


def content_hash(df: DataFrame, key: str) -> Column:
    """A hash of a row's plain columns other than the key."""
    return F.xxhash64(*(_plain_columns(df, key) or df.columns))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    hot_from: DataFrame | None = None,
) -> DataFrame:
    """Equi join on ``key`` with hot keys of ``left`` spread over several tasks.

    Those of ``hot_from`` are counted when the join is built, and written; a table of ``hot_rows`` rows or fewer
    needs no counting. ``right`` repeats only the rows of split keys, so it should hold few rows per key. Left
    rows without a key match nothing and are spread by their content. The keys are counted on
    ``hot_from``, by default ``left``: give the table ``left`` was derived from, to count a
    plain scan instead of computing ``left`` twice.

    Rows are told apart by the hash of their other plain columns. A left side that has the key
    alone is folded to counted rows first, since its rows can't be told apart.
    """
    if left.columns == [key]:
        return _counted_join(left, right, key, how, hot_rows)
    content = content_hash(left, key)
    # a null key meets nothing, so any number will do as its salt
    spread_null = F.when(F.col(key).isNull(), content)
    # as many rows as one task may take, or fewer: no key can be hot
    if hot_from is not None and hot_from.count() <= hot_rows:
        zero = F.lit(0).cast("bigint")
        alone = left.withColumn("salt", spread_null.otherwise(zero))
        return alone.join(right.withColumn("salt", zero), [key, "salt"], how).drop("salt")
    hot = hot_keys(left if hot_from is None else hot_from, key, hot_rows)
    if hot_from is not None:
        hot = cut_lineage(hot)  # counted once, although both sides and every reader look at it
    hot = F.broadcast(hot)  # bounded by HOT_KEYS
    salt = (
        spread_null.when(F.col("parts").isNotNull(), F.pmod(content, F.col("parts")))
        .otherwise(F.lit(0))
        .cast("bigint")
    )
    spread = left.join(hot, key, "left").withColumn("salt", salt).drop("parts")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("parts"), F.lit(1)).cast("bigint") - 1))
    repeated = right.join(hot, key, "left").withColumn("salt", copies).drop("parts")
    return spread.join(repeated, [key, "salt"], how).drop("salt")


def _counted_join(left: DataFrame, right: DataFrame, key: str, how: str, hot_rows: int) -> DataFrame:
    """The join of a left side of keys only: each key once per ``hot_rows`` rows, unfolded afterwards.

    What is shuffled is one row per key and part, and a part unfolds to ``hot_rows`` rows at most.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.lit(hot_rows)))).alias("_part")
    size = F.least(F.lit(hot_rows), F.col("_n") - F.col("_part") * hot_rows)
    folded = counts.select(key, "_n", parts).select(key, size.cast("bigint").alias("_size"))
    joined = folded.join(right, key, how)
    names = [c for c in joined.columns if c != "_size"]
    return joined.select(*names, F.explode(F.sequence(F.lit(1), F.col("_size"))).alias("_i")).drop("_i")


def adaptive_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """A plain join whose form adaptive execution picks by the bytes it has measured.

    It sends a small right side to all tasks, and splits the partitions of a hot key otherwise.
    """
    return left.join(right, key, how)


def lag_by_bucket(
    df: DataFrame, key: str, ts: str, ties: list[str], value: str, width_seconds: int
) -> DataFrame:
    """Add ``previous``: the value of the row before, by ``(ts, ties)`` within ``key``.

    The window runs within ``(key, time bucket)``; the first row of a bucket takes the last
    value of the nearest earlier bucket. So a hot key is cut along time, and what is left per
    key is one row per bucket.
    """
    bucket = F.floor(F.unix_seconds(F.col(ts)) / F.lit(width_seconds))
    rows = df.withColumn("bucket", bucket)
    order = [F.col(ts), *[F.col(c) for c in ties]]
    # a plain ordering column is folded by hashing, several are sorted first
    at_end = F.max_by(F.col(value), F.struct(*order) if ties else F.col(ts))
    lasts = rows.groupBy(key, "bucket").agg(at_end.alias("last"))
    per_key = Window.partitionBy(key).orderBy("bucket")
    carried = lasts.select(key, "bucket", F.lag("last").over(per_key).alias("carried"))
    within = Window.partitionBy(key, "bucket").orderBy(*order)
    numbered = rows.withColumn("position", F.row_number().over(within)).withColumn(
        "before", F.lag(value).over(within)
    )
    previous = F.when(F.col("position") == 1, F.col("carried")).otherwise(F.col("before"))
    return (
        numbered.join(carried, [key, "bucket"], "left")
        .withColumn("previous", previous)
        .drop("bucket", "position", "before", "carried")
    )
