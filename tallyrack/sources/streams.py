"""Stream sources and sinks. Parsing is separate, so a file stream can stand in for a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.functions.jsonio import event_json

USER_EVENTS = "user-events"
INVENTORY_EVENTS = "inventory-events"
CONSUMER_GROUP = "stream-features"


def stream_source(
    spark: SparkSession, kind: str, options: dict[str, str], schema: T.StructType | str = "value string"
) -> DataFrame:
    """A stream of ``value`` strings.

    ``kafka``: options as for the connector; new messages only unless told otherwise.
    ``text``, ``parquet`` or ``json``: files under ``path``.
    """
    if kind == "kafka":
        settings = {"startingOffsets": "latest", "kafka.group.id": CONSUMER_GROUP, **options}
        raw = spark.readStream.format("kafka").options(**settings).load()
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))
    rest = {k: v for k, v in options.items() if k != "path"}
    return spark.readStream.format(kind).schema(schema).options(**rest).load(options["path"])


def to_topic(df: DataFrame, key: str = "user_id", value=None) -> DataFrame:
    """Event rows -> ``(key, value)`` messages; the key keeps a user's events in order."""
    body = event_json() if value is None else value
    return df.select(F.col(key).cast("string").alias("key"), body.alias("value"))


def publish(messages: DataFrame, kind: str, options: dict[str, str], checkpoint: str | None = None):
    """Write messages to a topic or to files; a stream returns its running query."""
    if messages.isStreaming:
        writer = messages.writeStream.format(kind).options(**options)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    writer = messages.write.format(kind).options(**options)
    if kind == "kafka":
        writer.save()
    else:
        writer.mode("append").save()
    return None
