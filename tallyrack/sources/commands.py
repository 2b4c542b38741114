"""Command rows that change keyed state, and their application.

State is one table ``(key, kind, member, value, score, expires_at, ts, seq)``:

* ``string``  — a value under a key, ``member`` empty
* ``bit``     — ``member`` is the offset, ``value`` 0 or 1
* ``zset``    — ``member`` of a sorted set with its ``score``
* ``expiry``  — the expiry of a whole sorted set

A row of the command log may stand for a run of equal writes: every ``every_seconds`` from ``since`` to
``ts``, the last of them. Only the last can be the newest of its key, so a SET is applied as it is;
``each_write`` unfolds the runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrack.functions import keys
from tallyrack.functions.rules import in_stock
from tallyrack.operators.sessions import SESSION_TTL, activity_spans, last_life, with_session
from tallyrack.operators.skew import HOT_ROWS, salted_join

CLICKS_TTL = 3660
RUN_COLUMNS = ("since", "every_seconds")
STATE_COLUMNS = ("key", "kind", "member", "value", "score", "expires_at", "ts", "seq")


def _command(
    key: Column, operation: str, value: Column, field: Column | None = None,
    score: Column | None = None, ttl: int = 0,
) -> list[Column]:
    return [
        key.alias("key"),
        F.lit(operation).alias("operation"),
        value.cast("string").alias("value"),
        (F.lit("") if field is None else field.cast("string")).alias("field"),
        (F.lit(0.0) if score is None else score.cast("double")).alias("score"),
        F.lit(ttl).cast("bigint").alias("ttl_seconds"),
    ]


def click_commands(counts: DataFrame) -> DataFrame:
    """``(user_id, clicks, ts)`` -> SET of the click count; the columns of a run stay."""
    run = [c for c in RUN_COLUMNS if c in counts.columns]
    return counts.select(
        *_command(keys.user_clicks_1h(F.col("user_id")), "SET", F.col("clicks"), ttl=CLICKS_TTL), "ts", *run
    )


def each_write(commands: DataFrame) -> DataFrame:
    """One row per write: runs of equal writes unfolded to their times, other rows as they are."""
    if not set(RUN_COLUMNS) <= set(commands.columns):
        return commands
    times = F.sequence("since", "ts", F.make_dt_interval(secs=F.col("every_seconds")))
    times = F.when(F.col("since").isNull(), F.array("ts")).otherwise(times)
    others = [c for c in commands.columns if c not in ("ts", *RUN_COLUMNS)]
    return commands.select(*others, F.explode(times).alias("ts"))


def session_commands(events: DataFrame) -> DataFrame:
    """Session events -> ZADD of ``type:item:event`` scored by time."""
    member = F.concat_ws(":", "event_type", "item_id", "event_id")
    score = F.unix_millis("ts")
    return with_session(events).select(
        *_command(keys.session_events(F.col("session_id")), "ZADD", member, score=score, ttl=SESSION_TTL), "ts"
    )


def stock_commands(inventory: DataFrame) -> DataFrame:
    """Inventory events with a ``bit_offset`` -> SETBIT of the status and SET of the offset.

    The bit is 1 when the item is out of stock, the way the readers use it.
    """
    available = F.coalesce(in_stock(F.col("in_stock"), F.col("quantity")), F.lit(False))
    bit = F.when(available, "0").otherwise("1")
    setbit = _command(keys.stock_bitmap(), "SETBIT", bit, field=F.col("bit_offset"))
    offset = _command(keys.stock_id_map(F.col("item_id")), "SET", F.col("bit_offset"))
    both = F.array(F.struct(*setbit, "ts"), F.struct(*offset, "ts"))
    return inventory.select(F.inline(both))


def sequenced(commands: DataFrame) -> DataFrame:
    """Order commands by time, and equal times by content, so that a replay ends the same."""
    content = F.xxhash64("key", "operation", "field", "value")
    return commands.withColumn("seq", F.unix_micros("ts")).withColumn("tie", content)


def _rejection() -> Column:
    offset = F.col("field").try_cast("bigint")
    return F.when(
        ~F.col("operation").isin("SET", "SETBIT", "ZADD"), F.concat(F.lit("unknown operation: "), "operation")
    ).when((F.col("operation") == "SETBIT") & (offset.isNull() | (offset < 0)), "bad bit offset")


def _equal_writes(written: DataFrame) -> DataFrame:
    """Equal writes of a member folded to the newest by hashing; what is left is sorted for its last value."""
    order = F.coalesce("seq", F.lit(-(2**63)).cast("bigint"))
    folded = written.groupBy("key", "kind", "member", "value", "ttl", "tie").agg(
        *[F.max_by(c, order).alias(c) for c in ("score", "ts")], F.max("seq").alias("seq")
    )
    expires = F.col("ts") + F.make_dt_interval(secs=F.col("ttl"))
    return folded.select("key", "kind", "member", "value", "score", expires.alias("expires_at"), "ts", "seq", "tie")


def apply_commands(
    commands: DataFrame, state: DataFrame | None = None, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Apply commands ``(…, ts, seq)`` to state; returns the new state and the rejected rows.

    The last SET or SETBIT of a key wins. ZADD keeps the last score of a member and renews the
    expiry of its set; a set that expired between two writes starts empty. Equal writes fold first, so
    that a count written again and again is a few rows, then one aggregation per ``(key, member)`` takes the
    last; a busy key is folded before either shuffle.
    """
    judged = commands.withColumn("reject_reason", _rejection())
    rejected = judged.where(F.col("reject_reason").isNotNull())
    good = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    if "tie" not in good.columns:
        good = good.withColumn("tie", F.xxhash64("key", "operation", "field", "value"))
    is_set, is_zadd = F.col("operation") == "SET", F.col("operation") == "ZADD"
    # set members are apart from the rest, so that a reader of either skips the files of the other
    bit = F.when(F.col("value") == "1", "1").otherwise("0")
    values = good.where(F.col("operation").isin("SET", "SETBIT")).select(
        "key",
        F.when(is_set, "string").otherwise("bit").alias("kind"),
        F.when(is_set, "").otherwise(F.col("field").try_cast("bigint").cast("string")).alias("member"),
        F.when(is_set, F.col("value")).otherwise(bit).alias("value"),
        F.lit(None).cast("double").alias("score"),
        F.when(is_set & (F.col("ttl_seconds") > 0), F.col("ttl_seconds")).alias("ttl"),
        "ts",
        "seq",
        "tie",
    )
    added = good.where(is_zadd | F.col("operation").isNull()).select(
        "key",
        F.lit("zset").alias("kind"),
        F.col("value").alias("member"),
        F.lit(None).cast("string").alias("value"),
        F.when(is_zadd, F.col("score")).alias("score"),
        F.lit(None).cast("bigint").alias("ttl"),
        "ts",
        "seq",
        "tie",
    )
    written = _equal_writes(values).unionByName(_equal_writes(added))
    zadds = good.where(is_zadd)
    spans = activity_spans(zadds, ["key"], "ts", F.col("ttl_seconds"))
    members = zadds.select("key")
    if state is not None:
        members = members.unionAll(state.where(F.col("kind") == "zset").select("key"))
        known = state.where(F.col("kind") != "expiry").select(*STATE_COLUMNS)
        written = written.unionByName(known.withColumn("tie", F.lit(None).cast("bigint")))
        old = state.where(F.col("kind") == "expiry")
        spans = spans.unionByName(
            old.select("key", F.col("ts").alias("opened"), F.col("expires_at").alias("until"))
        )
    latest = F.max_by(F.struct("value", "score", "expires_at", "ts", "seq"), F.struct("seq", "tie"))
    folded = written.groupBy("key", "kind", "member").agg(latest.alias("last")).select(
        "key", "kind", "member", "last.*"
    )
    lives = last_life(spans, ["key"]).withColumnRenamed("expires_at", "set_expires")
    sets = salted_join(folded.where(F.col("kind") == "zset"), lives, "key", "left", hot_rows, members)
    sets = sets.where(F.col("alive_from").isNull() | (F.col("ts") >= F.col("alive_from")))
    expiry = lives.select(
        "key",
        F.lit("expiry").alias("kind"),
        F.lit("").alias("member"),
        F.lit(None).cast("string").alias("value"),
        F.lit(None).cast("double").alias("score"),
        F.col("set_expires").alias("expires_at"),
        F.col("alive_from").alias("ts"),
        F.lit(None).cast("bigint").alias("seq"),
    )
    out = (
        folded.where(F.col("kind") != "zset")
        .unionByName(sets.select(*STATE_COLUMNS))
        .unionByName(expiry)
    )
    return out.select(*STATE_COLUMNS), rejected.drop("tie")


def live_state(state: DataFrame, as_of: Column) -> DataFrame:
    """State rows alive at an instant, without the expiry rows.

    Sorted sets share the expiry of their key.
    """
    spans = state.where(F.col("kind") == "expiry").select("key", F.col("expires_at").alias("set_expires"))
    members = salted_join(state.where(F.col("kind") == "zset").drop("expires_at"), spans, "key")
    members = members.withColumnRenamed("set_expires", "expires_at").select(*STATE_COLUMNS)
    plain = state.where(F.col("kind").isin("string", "bit")).select(*STATE_COLUMNS)
    rows = plain.unionByName(members)
    return rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
