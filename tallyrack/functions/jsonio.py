"""JSON forms of events, recommendation lists and experiment configs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrack import schemas

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def parse_time(text: Column) -> Column:
    """RFC 3339 text or epoch milliseconds -> timestamp; anything else -> null."""
    millis = F.when(text.rlike("^-?[0-9]{1,15}$"), F.timestamp_millis(text.try_cast("bigint")))
    return F.coalesce(millis, F.when(text.rlike("^[0-9]{4}-"), F.try_to_timestamp(text)))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def event_json() -> Column:
    """Event columns -> JSON; metadata fields that are empty are left out."""
    meta = F.struct(
        F.nullif(F.col("metadata.query"), F.lit("")).alias("query"),
        F.nullif(F.col("metadata.position"), F.lit(0)).alias("position"),
        F.nullif(F.col("metadata.price"), F.lit(0).cast("bigint")).alias("price"),
        F.nullif(F.col("metadata.source"), F.lit("")).alias("source"),
    )
    return F.to_json(
        F.struct(
            _text(F.col("event_id")).alias("event_id"),
            _text(F.col("user_id")).alias("user_id"),
            _text(F.col("event_type")).alias("event_type"),
            _text(F.col("item_id")).alias("item_id"),
            _text(F.col("category_id")).alias("category_id"),
            F.date_format(F.col("ts"), TIME_FORMAT).alias("timestamp"),
            _text(F.col("session_id")).alias("session_id"),
            meta.alias("metadata"),
        )
    )


def recs_to_json(items: Column) -> Column:
    """Array of ``(item_id, score)`` -> JSON list."""
    return F.to_json(items)


def recs_from_json(value: Column) -> Column:
    """JSON list -> array of ``(item_id, score)``; null when it is not one."""
    return F.from_json(value, schemas.RECOMMENDATIONS)


def experiment_from_json(value: Column) -> Column:
    return F.from_json(value, schemas.EXPERIMENT_JSON)
