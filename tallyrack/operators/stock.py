"""Stock state, bitmap and the out-of-stock filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.functions.rules import in_stock
from tallyrack.operators.numbering import number_rows
from tallyrack.operators.skew import adaptive_join, lag_by_bucket


def _effective() -> Column:
    return F.coalesce(in_stock(F.col("in_stock"), F.col("quantity")), F.lit(False))


def stock_state(inventory: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Latest status per item by event time; ``ties`` order events of the same instant.

    Without ``ties`` the buffers are plain values and the rows are hashed; with them each task
    sorts its rows before it folds them.
    """
    if not ties:
        status = F.max_by(_effective(), F.col("ts"))
        return inventory.groupBy("item_id").agg(
            status.alias("in_stock"), (~status).alias("out_of_stock"), F.max("ts").alias("ts")
        )
    order = F.struct(*[F.col(c) for c in ["ts", *ties]])
    latest = F.max_by(F.struct(_effective().alias("in_stock"), F.col("ts")), order)
    return inventory.groupBy("item_id").agg(latest.alias("latest")).select(
        "item_id",
        F.col("latest.in_stock").alias("in_stock"),
        (~F.col("latest.in_stock")).alias("out_of_stock"),
        F.col("latest.ts").alias("ts"),
    )


def with_offsets(state: DataFrame) -> DataFrame:
    """Give every item a dense bitmap offset from 0, in item order."""
    return number_rows(state, ["item_id"], "bit_offset")


def stock_bitmap(stock: DataFrame) -> DataFrame:
    """Packed bitmap, bit 1 = out of stock: one row per 32768 offsets with a bit set.

    Spark counts bitmap positions from 1, so offset n is position n + 1: bucket b holds the
    offsets from (b - 1) * 32768.
    """
    position = F.col("bit_offset").cast("bigint") + 1
    return (
        stock.where(F.col("out_of_stock"))
        .groupBy(F.bitmap_bucket_number(position).alias("bucket"))
        .agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bitmap"),
            F.count("*").alias("out_of_stock_items"),
        )
    )


def bit_is_set(bitmap: Column, offset: Column) -> Column:
    """Read the bit of an offset from the bitmap of its bucket."""
    bit = F.bitmap_bit_position(offset + 1)
    digits = F.substr(F.hex(bitmap), (F.floor(bit / 8) * 2 + 1).cast("int"), F.lit(2))
    return F.getbit(F.conv(digits, 16, 10).cast("bigint"), (bit % 8).cast("int")) == 1


def blocked_items(stock: DataFrame) -> DataFrame:
    """Items that are known, have a readable offset and are out of stock."""
    readable = F.col("bit_offset").cast("string").try_cast("bigint").isNotNull()
    return stock.where(F.col("out_of_stock") & readable).select("item_id").distinct()


def filter_in_stock(candidates: DataFrame, stock: DataFrame) -> DataFrame:
    """Drop out-of-stock candidates; unknown items and unreadable offsets stay.

    Popular items repeat in many candidate lists; adaptive execution sends the blocked items to
    all tasks while their bytes are few and splits hot items beyond that.
    """
    return adaptive_join(candidates, blocked_items(stock), "item_id", "left_anti")


def probe_stock(items: DataFrame, stock: DataFrame) -> DataFrame:
    """Add ``out_of_stock`` to a list of items; false when nothing is known."""
    blocked = blocked_items(stock).withColumn("out_of_stock", F.lit(True))
    joined = adaptive_join(items, blocked, "item_id")
    return joined.fillna({"out_of_stock": False})


def stock_flips(
    inventory: DataFrame, ties: list[str] | None = None, width_seconds: int = 86_400
) -> DataFrame:
    """Status changes per item, with direction."""
    rows = inventory.withColumn("now_in_stock", _effective())
    lagged = lag_by_bucket(rows, "item_id", "ts", ties or [], "now_in_stock", width_seconds)
    flip = F.when(F.col("previous") & ~F.col("now_in_stock"), "in_to_out").when(
        ~F.col("previous") & F.col("now_in_stock"), "out_to_in"
    )
    return lagged.withColumn("flip", flip).where(F.col("flip").isNotNull()).drop("previous")


def update_lag(applied: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Delay from event time to apply time, in seconds."""
    lag = F.unix_micros("apply_ts") - F.unix_micros("ts")
    return applied.groupBy(*(by or [])).agg(
        F.count("*").alias("updates"), (F.max(lag) / 1e6).alias("max_lag_seconds")
    )
