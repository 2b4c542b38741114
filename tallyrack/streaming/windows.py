"""Sliding-window counts on batches and streams, and their value at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.functions.rules import is_click
from tallyrack.streaming.stateful import pane_runs, pane_sums

HOUR, DAY = 3600, 86_400
CLICKS_SLIDE = 60
CLICKS_TTL = 3660
DELAY = "5 seconds"


def watermarked(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Event time with bounded lateness. A zero delay gives a monotonic watermark."""
    return events.withWatermark("ts", delay) if events.isStreaming else events


def sliding_sums(
    events: DataFrame, key: str, measures: dict[str, Column], size: int, slide: int, delay: str = DELAY
) -> DataFrame:
    """Counts of each condition per ``key`` and window ``[window_start, window_end)``.

    Every key with any event in a window has a row. On a stream, closed windows are final and
    later events do not change them; a key's panes are its state (``stateful.pane_sums``), which needs
    RocksDB (``job.use_rocksdb``). A batch first folds events into one row per key and
    slide, a busy key to one row per slide at most. Each row enters the windows at one end and leaves them
    ``size / slide`` ends later; running sums over these ends, in order, give runs of equal windows,
    which unfold last. So no task holds or sorts a row per window.
    """
    if size % slide:
        raise ValueError("size must be a multiple of slide")
    if events.isStreaming:
        return pane_sums(events, key, measures, size, slide, delay)
    slot = F.floor(F.unix_micros("ts") / (slide * 1_000_000))
    slots = events.groupBy(key, slot.alias("slot")).agg(
        *[F.count_if(c).alias(n) for n, c in measures.items()]
    )
    panes = size // slide
    enter = F.struct((F.col("slot") + 1).alias("end"), F.lit(1).alias("_panes"), *measures)
    leave = F.struct((F.col("slot") + 1 + panes).alias("end"), F.lit(-1).alias("_panes"), *[(-F.col(n)).alias(n) for n in measures])
    edges = (
        slots.where(F.col("slot").isNotNull())
        .repartition(key)
        .select(key, F.inline(F.array(enter, leave)))
        .groupBy(key, "end")
        .agg(*[F.sum(n).alias(n) for n in ("_panes", *measures)])
    )
    in_order = Window.partitionBy(key).orderBy("end")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = edges.select(
        key, "end", F.lead("end").over(in_order).alias("_next"), *[F.sum(n).over(so_far).alias(n) for n in ("_panes", *measures)]
    ).where(F.col("_panes") > 0)
    end = F.explode(F.sequence(F.col("end"), F.col("_next") - 1)).alias("_end")
    return runs.select(key, end, *measures).select(
        key,
        F.timestamp_seconds(F.col("_end") * slide - size).alias("window_start"),
        F.timestamp_seconds(F.col("_end") * slide).alias("window_end"),
        *measures,
    )


def sliding_count(
    events: DataFrame, key: str, condition: Column, size: int, slide: int, name: str = "n", delay: str = DELAY
) -> DataFrame:
    return sliding_sums(events, key, {name: condition}, size, slide, delay)


def clicks_1h(events: DataFrame) -> DataFrame:
    """Clicks per user in the last hour, every minute."""
    return sliding_count(events, "user_id", is_click(F.col("event_type")), HOUR, CLICKS_SLIDE, "clicks")


def clicks_1h_runs(events: DataFrame) -> DataFrame:
    """The windows of ``clicks_1h`` over a stream, with those of equal count one after the other in a row.

    ``(user_id, first_end, window_end, clicks)``: a window ends every minute from ``first_end`` to ``window_end``.
    """
    runs = pane_runs(events, "user_id", {"clicks": is_click(F.col("event_type"))}, HOUR, CLICKS_SLIDE, DELAY)
    first, last = (F.timestamp_seconds(F.col(end) * CLICKS_SLIDE) for end in ("first_end", "last_end"))
    return runs.select("user_id", first.alias("first_end"), last.alias("window_end"), "clicks")


def views_1d(events: DataFrame) -> DataFrame:
    """Views per user in the last day, every hour."""
    return sliding_count(events, "user_id", F.col("event_type") == "view", DAY, HOUR, "views")


def ctr_7d(events: DataFrame) -> DataFrame:
    """Click-through rate per item over seven days, every day."""
    kind = F.col("event_type")
    sums = sliding_sums(events, "item_id", {"clicks": kind == "click", "views": kind == "view"}, 7 * DAY, DAY)
    return sums.withColumn("ctr", F.col("clicks") / F.greatest(F.col("views"), F.lit(1)))


def current(windows: DataFrame, key: str, as_of: Column, ttl: int) -> DataFrame:
    """The latest window of each key that ended by ``as_of`` and has not expired."""
    names = [c for c in windows.columns if c not in (key, "window_start", "window_end")]
    ended = windows.where(F.col("window_end") <= as_of)
    # plain columns, not a struct: these fold by hashing, a struct would have every window sorted
    last = ended.groupBy(key).agg(
        F.max("window_end").alias("_end"), *[F.max_by(n, F.col("window_end")).alias(n) for n in names]
    )
    expires = F.col("_end") + F.make_dt_interval(secs=F.lit(ttl))
    return last.select(key, F.col("_end").alias("window_end"), *names, expires.alias("expires_at")).where(
        F.col("expires_at") > as_of
    )


def count_as_of(
    events: DataFrame, key: str, condition: Column, size: int, slide: int, as_of: Column, ttl: int, name: str = "n"
) -> DataFrame:
    """Same result as ``current`` over all windows, reading only the events that can matter.

    The last window of a key ends ``size`` after its last event, or at ``as_of``. So events
    older than ``size + ttl`` are left out by the scan, and each key keeps one row per slide.
    """
    width = slide * 1_000_000
    last_end = F.floor(F.unix_micros(as_of) / width)
    horizon = as_of - F.make_dt_interval(secs=F.lit(size + ttl))
    recent = events.where((F.col("ts") >= horizon) & (F.col("ts") < as_of))
    slots = (
        recent.withColumn("slot", F.floor(F.unix_micros("ts") / width))
        .where(F.col("slot") < last_end)
        .groupBy(key, "slot")
        .agg(F.count_if(condition).alias(name))
    )
    latest = F.max("slot").over(Window.partitionBy(key))
    placed = slots.withColumn("end", F.least(latest + size // slide, last_end))
    inside = placed.where(F.col("slot") >= F.col("end") - size // slide)
    counted = inside.groupBy(key, "end").agg(F.sum(name).alias(name))
    end = F.timestamp_seconds(F.col("end") * slide)
    return counted.select(
        key, end.alias("window_end"), name, (end + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at")
    ).where(F.col("expires_at") > as_of)


def dedup(events: DataFrame, delay: str = DELAY, key: str = "event_id") -> DataFrame:
    """Drop repeated events: on a stream within the watermark, on a batch altogether."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
