"""Streams with a state of their own per key: sliding sums over panes, and the session tail.

A state row, of a bucket of keys or of a session, is read and written once by a call; event-time timers
act when the watermark passes. They run on RocksDB (``job.use_rocksdb``) in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tallyrack.operators.ranking import LAST_EVENTS
from tallyrack.operators.sessions import SESSION_TTL, with_session

# Sliding sums ----------------------------------------------------------------

#: Keys share a state row by their hash: a call costs milliseconds, so there are this many rows, not one per key.
BUCKETS = 2048
#: Panes whose windows are made at once.
PANES_AT_ONCE = 1 << 16


def keyed_runs(
    keys: np.ndarray, panes: np.ndarray, sums: np.ndarray, width: int, since: int, until: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sliding sums of panes sorted by key number as runs ``(key, first_end, last_end, sums)`` of equal value.

    A window that ends before slot ``e`` holds the panes e - width .. e - 1. Ends in (since, until] with
    any pane count; a run stops where a pane of its key enters or leaves.
    """
    every = np.unique(keys)
    owner = np.concatenate([keys, keys, every, every])
    edge = np.concatenate([panes + 1, panes + 1 + width, np.full(len(every), since + 1), np.full(len(every), until + 1)])
    inside = (edge > since) & (edge <= until + 1)
    # all keys on one axis, each with a stretch of its own that no window of another reaches
    low = min(int(panes.min()), since) - width
    stretch = max(int(panes.max()), until) + width + 2 - low
    edges = np.unique(owner[inside] * stretch + (edge[inside] - low))
    owner, edge = edges // stretch, edges % stretch + low
    whole = owner[:-1] == owner[1:]
    owner, first, last = owner[:-1][whole], edge[:-1][whole], edge[1:][whole] - 1
    total = np.concatenate([np.zeros((1, sums.shape[1]), dtype=np.int64), np.cumsum(sums, axis=0)])
    placed = keys * stretch + (panes - low)
    begin, end = (np.searchsorted(placed, owner * stretch + (e - low)) for e in (first - width, first))
    held = end > begin
    return owner[held], first[held], last[held], (total[end] - total[begin])[held]


def runs_of(panes: np.ndarray, sums: np.ndarray, width: int, since: int, until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keyed_runs`` of a single key."""
    return keyed_runs(np.zeros(len(panes), dtype=np.int64), panes, sums, width, since, until)[1:]


def folded(table: np.ndarray) -> np.ndarray:
    """Rows ``(key, pane, sums)`` in order, one per key and pane."""
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    new = np.ones(len(table), dtype=bool)
    new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
    first = np.flatnonzero(new)
    return np.concatenate([table[first, :2], np.add.reduceat(table[:, 2:], first, axis=0)], axis=1)


class _Sums(StatefulProcessor):
    """State of a bucket: its keys with the panes that open windows still need, and the last end that was given out."""

    def __init__(self, key: str, measures: list[str], width: int, slide: int, closed_panes: bool) -> None:
        self.key, self.measures, self.width, self.slide, self.closed_panes = key, measures, width, slide, closed_panes

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("panes", "keys array<string>, panes binary, done bigint, timer bigint")

    def _load(self) -> tuple[np.ndarray, np.ndarray, int | None, int | None]:
        held = self.state.get()
        if held is None:
            return np.zeros(0, dtype=object), np.zeros((0, 2 + len(self.measures)), dtype=np.int64), None, None
        keys, panes, done, timer = held
        return np.array(keys, dtype=object), np.frombuffer(bytes(panes), dtype=np.int64).reshape(-1, 2 + len(self.measures)), done, timer

    def _closed(self, keys: np.ndarray, table: np.ndarray, since: int, until: int) -> Iterator[pd.DataFrame]:
        """The windows that end in (since, until]."""
        if until <= since or not len(table):
            return
        starts = np.flatnonzero(np.diff(table[:, 0])) + 1
        at = np.searchsorted(starts, np.arange(PANES_AT_ONCE, len(table), PANES_AT_ONCE))
        for part in np.split(table, np.unique(starts[at[at < len(starts)]])):
            owner, first, last, sums = keyed_runs(part[:, 0], part[:, 1], part[:, 2:], self.width, since, until)
            if len(first):
                columns = {self.key: keys[owner], "first_end": first, "last_end": last}
                yield pd.DataFrame(columns | {m: sums[:, i] for i, m in enumerate(self.measures)})

    def _save(self, keys: np.ndarray, table: np.ndarray, done: int, timer: int | None, watermark_ms: int) -> None:
        """Keep what open windows need, and set the timer for the next end."""
        table = table[table[:, 1] + self.width > done]
        following = None
        if len(table):
            following = (max(int(table[:, 1].min()), done) + 1) * self.slide * 1000
            left, number = np.unique(table[:, 0], return_inverse=True)
            panes = np.concatenate([number.reshape(-1, 1), table[:, 1:]], axis=1)
            self.state.update((keys[left].tolist(), panes.tobytes(), done, following))
        elif timer is not None:
            self.state.clear()
        if following != timer:
            if timer is not None and timer > watermark_ms:  # one that has gone off is gone
                self.handle.deleteTimer(timer)
            if following is not None:
                self.handle.registerTimer(following)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        keys, table, done, timer = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        closed = watermark // (1000 * self.slide)
        if not self.closed_panes:  # what the watermark has closed is final before these events are added
            if done is not None:
                yield from self._closed(keys, table, done, closed)
            done = closed
        names, new = [keys[table[:, 0]]], [table[:, 1:]]
        for batch in rows:
            names.append(batch[self.key].to_numpy(dtype=object))
            new.append(batch[["slot", *self.measures]].to_numpy(dtype=np.int64))
        number, found = pd.factorize(np.concatenate(names), use_na_sentinel=False)
        keys = np.array([k if isinstance(k, str) else None for k in found], dtype=object)
        table = folded(np.concatenate([number.astype(np.int64).reshape(-1, 1), np.concatenate(new)], axis=1))
        if self.closed_panes:  # panes come with the watermark that closed them, and it may have closed windows too
            yield from self._closed(keys, table, int(table[:, 1].min()) if done is None else done, closed)
        self._save(keys, table, closed, timer, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        keys, table, done, timer = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        closed = watermark // (1000 * self.slide)
        if done is not None and closed > done:
            yield from self._closed(keys, table, done, closed)
            self._save(keys, table, closed, timer, watermark)


def pane_runs(
    events: DataFrame, key: str, measures: dict[str, Column], size: int, slide: int, delay: str, panes_first: bool = False
) -> DataFrame:
    """The windows of ``pane_sums`` as runs of equal sums: ``(key, first_end, last_end, sums)``.

    Ends count slides since the epoch; a run stands for a window at each of its ends. A run that goes on
    beyond the watermark comes in parts.

    Keys are dealt by hash to ``BUCKETS`` state rows: (key, pane, sums) for the panes that open windows need,
    ``size / slide`` per key and those ahead of the watermark at most. So an event adds to one pane where a
    sliding window aggregation opens ``size / slide`` state rows, and a batch makes a call per bucket, however
    many keys there are. Closed windows leave as runs of equal sums. An event late by less than ``size`` still counts in the windows
    that are open, as it does in a sliding window aggregation.

    ``panes_first`` folds events to one row per key and pane in an aggregation before the state, in the
    same query, so that a key that holds a great share of all events reaches its task as one
    row per pane; then an event counts only if its own pane is still open.
    """
    if size % slide:
        raise ValueError("size must be a multiple of slide")
    held = events.withWatermark("ts", delay)
    if panes_first:
        rows = held.groupBy(key, F.window("ts", f"{slide} seconds").alias("w")).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
        slot = F.floor(F.unix_micros(F.col("w.start")) / (slide * 1_000_000))
        sums = [F.col(n) for n in measures]
    else:
        rows = held.where(F.col("ts").isNotNull())
        slot = F.floor(F.unix_micros("ts") / (slide * 1_000_000))
        sums = [F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in measures.items()]
    kind = events.schema[key].dataType
    bucket = F.pmod(F.hash(key), F.lit(BUCKETS)).alias("_bucket")
    rows = rows.select(bucket, F.col(key).cast("string").alias(key), slot.alias("slot"), *sums)
    schema = T.StructType(
        [T.StructField(key, T.StringType()), T.StructField("first_end", T.LongType()), T.StructField("last_end", T.LongType())]
        + [T.StructField(n, T.LongType()) for n in measures]
    )
    processor = _Sums(key, list(measures), size // slide, slide, panes_first)
    runs = rows.groupBy("_bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return runs.select(F.col(key).cast(kind).alias(key), "first_end", "last_end", *measures)


def pane_sums(
    events: DataFrame, key: str, measures: dict[str, Column], size: int, slide: int, delay: str, panes_first: bool = False
) -> DataFrame:
    """The rows of ``windows.sliding_sums`` over a stream: ``pane_runs``, unfolded to windows in the JVM."""
    runs = pane_runs(events, key, measures, size, slide, delay, panes_first)
    end = F.explode(F.sequence("first_end", "last_end"))
    return runs.select(key, end.alias("_end"), *measures).select(
        key,
        F.timestamp_seconds(F.col("_end") * slide - size).alias("window_start"),
        F.timestamp_seconds(F.col("_end") * slide).alias("window_end"),
        *measures,
    )


# Sessions --------------------------------------------------------------------

_EVENT = "event_id string, event_type string, item_id string, ts bigint"
#: A new version of a session's features, or the end of a session.
TAIL = "session_id string, clicked array<string>, viewed array<string>, session_length int, last_ts timestamp, expires_at timestamp, expired boolean"


class _Tail(StatefulProcessor):
    """State of a session: its newest events since it last expired, as a list."""

    def __init__(self, n: int, ttl_seconds: int) -> None:
        self.n, self.ttl = n, ttl_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)

    def _row(self, key: tuple, events: list[tuple], expired: bool) -> pd.DataFrame:
        last = events[-1][3]
        items = {kind: [] if expired else sorted({e[2] for e in events if e[1] == kind and e[2] is not None}) for kind in ("click", "view")}
        return pd.DataFrame({
            "session_id": [key[0]], "clicked": [items["click"]], "viewed": [items["view"]], "session_length": [0 if expired else len(events)],
            "last_ts": [pd.Timestamp(last, unit="us", tz="UTC")], "expires_at": [pd.Timestamp(last + self.ttl, unit="us", tz="UTC")], "expired": [expired],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        for batch in rows:
            events += list(batch[["event_id", "event_type", "item_id", "ts"]].astype(object).where(batch.notna(), None).itertuples(index=False, name=None))
        events.sort(key=lambda e: (e[3], e[0] or ""))
        times = [e[3] for e in events]
        fresh = [i for i in range(1, len(times)) if times[i] - times[i - 1] >= self.ttl]
        events = events[fresh[-1] if fresh else 0 :][-self.n :]
        self.events.put([(a, b, c, int(t)) for a, b, c, t in events])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(int(events[-1][3]) + self.ttl) // 1000))
        yield self._row(key, events, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        if events:
            self.events.clear()
            yield self._row(key, events, True)


def session_tail(events: DataFrame, delay: str, n: int = LAST_EVENTS, ttl_seconds: int = SESSION_TTL) -> DataFrame:
    """Session features as a stream of versions: ``TAIL``, one row per session and micro-batch that touched it.

    The newest ``n`` events since a session's last expiry are its state. When the watermark passes
    ``ttl_seconds`` after its last event the state goes, and a row with ``expired`` says so. Later
    versions replace earlier ones: the one with the latest ``last_ts``, an expiry after its version
    (``latest_tail``). Events behind the watermark take no part. Features equal
    ``session_features`` over ``session_buffer``, the newest ``n`` events.
    """
    rows = with_session(events).withWatermark("ts", delay).select(
        F.col("session_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.col("item_id").cast("string").alias("item_id"), F.col("ts").alias("event_time"), F.unix_micros("ts").alias("ts"),
    )
    return rows.groupBy("session_id").transformWithStateInPandas(_Tail(n, ttl_seconds), TAIL, "Append", "EventTime")


def latest_tail(versions: DataFrame) -> DataFrame:
    """The newest version of each session from the rows written so far."""
    order = F.struct("last_ts", "expired", "session_length")
    columns = [c for c in versions.columns if c != "session_id"]
    return versions.groupBy("session_id").agg(F.max_by(F.struct(*columns), order).alias("v")).select("session_id", "v.*")
