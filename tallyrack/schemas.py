"""Fixed schemas of events, inventory, recommendations and commands."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, INT, LONG, DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
BOOLEAN, TIMESTAMP = T.BooleanType(), T.TimestampType()

METADATA = _struct(query=STRING, position=INT, price=LONG, source=STRING)

#: A user event as a table row.
EVENT = _struct(
    event_id=STRING,
    user_id=STRING,
    event_type=STRING,
    item_id=STRING,
    category_id=STRING,
    ts=TIMESTAMP,
    session_id=STRING,
    metadata=METADATA,
)

#: A user event as JSON. The timestamp is text: RFC 3339 or epoch milliseconds.
EVENT_JSON = _struct(
    event_id=STRING,
    user_id=STRING,
    event_type=STRING,
    item_id=STRING,
    category_id=STRING,
    timestamp=STRING,
    session_id=STRING,
    metadata=METADATA,
)

INVENTORY_JSON = _struct(item_id=STRING, in_stock=BOOLEAN, quantity=INT, timestamp=STRING)

RECOMMENDATION = _struct(item_id=STRING, score=DOUBLE)
RECOMMENDATIONS = T.ArrayType(RECOMMENDATION)

EXPERIMENT_JSON = _struct(id=STRING, model_version=STRING, traffic_pct=DOUBLE, tier_config=STRING)

#: One write to keyed state. ``seq`` orders the writes.
COMMAND = _struct(
    key=STRING,
    operation=STRING,
    value=STRING,
    field=STRING,
    score=DOUBLE,
    ttl_seconds=LONG,
    ts=TIMESTAMP,
    seq=LONG,
)
