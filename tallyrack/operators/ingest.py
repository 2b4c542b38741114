"""Validation, enrichment and JSON form of events and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack import schemas
from tallyrack.functions import jsonio
from tallyrack.functions.rules import EVENT_TYPES

_BAD = "_bad"


def _checked(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])


def _decode(value: Column, schema: T.StructType) -> Column:
    return F.from_json(value, _checked(schema), {"columnNameOfCorruptRecord": _BAD})


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column worked out once per row: a generated one is not copied into every filter and column above it."""
    return df.drop(name).select("*", F.explode(F.array(value)).alias(name))


def judge_events(df: DataFrame) -> DataFrame:
    """Decode ``value`` and add ``reject_reason``: the first failing rule, or null."""
    body = F.col("body")
    reason = (
        F.when(F.col("value").isNull() | body.isNull() | body[_BAD].isNotNull(), "invalid JSON")
        .when(~_text(body["event_type"]).isin(*EVENT_TYPES), "invalid event_type")
        .when(_text(body["user_id"]) == "", "user_id is required")
        .when(_text(body["item_id"]) == "", "item_id is required")
    )
    return df.withColumn("body", _decode(F.col("value"), schemas.EVENT_JSON)).withColumn(
        "reject_reason", reason
    )


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw JSON in ``value`` -> accepted event columns, and rejected rows with a reason."""
    judged = judge_events(df)
    others = [c for c in df.columns if c != "value"]
    accepted = judged.where(F.col("reject_reason").isNull())
    return (
        accepted.select(*others, *_event_columns()),
        judged.where(F.col("reject_reason").isNotNull()).drop("body"),
    )


def _event_columns(ts: Column | None = None) -> list[Column]:
    body, meta = F.col("body"), F.col("body.metadata")
    return [
        _text(body["event_id"]).alias("event_id"),
        body["user_id"].alias("user_id"),
        body["event_type"].alias("event_type"),
        _text(body["item_id"]).alias("item_id"),
        _text(body["category_id"]).alias("category_id"),
        (jsonio.parse_time(body["timestamp"]) if ts is None else ts).alias("ts"),
        _text(body["session_id"]).alias("session_id"),
        F.struct(
            _text(meta["query"]).alias("query"),
            F.coalesce(meta["position"], F.lit(0)).alias("position"),
            F.coalesce(meta["price"], F.lit(0).cast("bigint")).alias("price"),
            _text(meta["source"]).alias("source"),
        ).alias("metadata"),
    ]


def parse_events(df: DataFrame) -> DataFrame:
    """Event topic ``value`` -> event columns plus ``parse_error``; unknown fields are ignored."""
    others = [c for c in df.columns if c != "value"]
    parsed = _once(df, "body", _decode(F.col("value"), schemas.EVENT_JSON))
    parsed = _once(parsed, "_parsed_time", jsonio.parse_time(F.col("body.timestamp")))
    bad = F.col("body").isNull() | F.col(f"body.{_BAD}").isNotNull()
    bad = bad | F.col("body.user_id").isNull() | F.col("_parsed_time").isNull()
    return parsed.select(*others, *_event_columns(F.col("_parsed_time")), bad.alias("parse_error"))


def parse_inventory(df: DataFrame) -> DataFrame:
    """Inventory topic ``value`` -> ``item_id, in_stock, quantity, ts, parse_error``."""
    others = [c for c in df.columns if c != "value"]
    body = F.col("body")
    parsed = _once(df, "body", _decode(F.col("value"), schemas.INVENTORY_JSON))
    parsed, ts = _once(parsed, "_parsed_time", jsonio.parse_time(body["timestamp"])), F.col("_parsed_time")
    bad = body.isNull() | body[_BAD].isNotNull() | body["item_id"].isNull() | ts.isNull()
    return parsed.select(
        *others,
        body["item_id"].alias("item_id"),
        body["in_stock"].alias("in_stock"),
        body["quantity"].alias("quantity"),
        ts.alias("ts"),
        bad.alias("parse_error"),
    )


def enrich_events(
    df: DataFrame, ingest_ts: Column | None = None, id_from: list[str] | None = None
) -> DataFrame:
    """Give accepted events a server id and an ingest time.

    ``id_from`` makes the id a hash of these columns, so that a replayed batch gets the same
    ids. Without it the id is random, as for a live request.
    """
    if id_from:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_from]
        event_id = F.sha2(F.concat_ws("|", *parts), 256)
    else:
        event_id = F.uuid()
    when = F.current_timestamp() if ingest_ts is None else ingest_ts
    return df.withColumn("event_id", event_id).withColumn("ts", when)


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests without a user are rejected."""
    missing = _text(F.col("user_id").cast("string")) == ""
    rejected = df.where(missing).withColumn("reject_reason", F.lit("user_id is required"))
    return df.where(~missing), rejected


def check_dims(df: DataFrame, dims: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Rows whose vectors have the stated lengths, and the others with the first failure."""
    reason = F.lit(None).cast("string")
    for name, dim in reversed(dims.items()):
        size = F.coalesce(F.size(F.col(name)), F.lit(-1))
        size = F.when(F.col(name).isNull(), F.lit(0)).otherwise(size)
        text = F.concat(F.lit(f"{name}: expected dim {dim}, got "), size.cast("string"))
        reason = F.when(size != dim, text).otherwise(reason)
    judged = df.withColumn("reject_reason", reason)
    return (
        judged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
        judged.where(F.col("reject_reason").isNotNull()),
    )
