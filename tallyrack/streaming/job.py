"""The streaming feature job: click windows, session buffer and stock status.

Each branch turns events into commands and appends them to a command folder. The file sink
and the checkpoint make every command appear once, also after a restart. State is the fold of
the commands (``sources.commands.apply_commands``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyrack.operators.ingest import parse_events, parse_inventory
from tallyrack.sources import commands as cmd
from tallyrack.streaming.windows import CLICKS_SLIDE, clicks_1h_runs

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Checkpoints write changes only, and no row count is kept: a read less per write.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def use_rocksdb(spark: SparkSession) -> None:
    """Keep stream state outside the JVM heap."""
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)


def start(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, partition: str | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet folder."""
    writer = df.writeStream.format("parquet").outputMode("append")
    if partition:
        writer = writer.partitionBy(partition)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def click_branch(events: DataFrame) -> DataFrame:
    """A SET per user and window; windows of equal count one after the other are a row of the log (``commands.each_write``)."""
    every = F.lit(CLICKS_SLIDE).cast("bigint").alias("every_seconds")
    runs = clicks_1h_runs(events).select(
        "user_id", "clicks", F.col("window_end").alias("ts"), F.col("first_end").alias("since"), every
    )
    return cmd.click_commands(runs)


def session_branch(events: DataFrame) -> DataFrame:
    return cmd.session_commands(events)


def placed(inventory: DataFrame, offsets: DataFrame) -> DataFrame:
    """Inventory events with the offset of their item; null for an item without one."""
    return inventory.join(offsets.select("item_id", "bit_offset"), "item_id", "left")


def stock_branch(inventory: DataFrame, offsets: DataFrame) -> DataFrame:
    """Stock commands of the items that have an offset."""
    return cmd.stock_commands(placed(inventory, offsets).where(F.col("bit_offset").isNotNull()))


def rejected_branch(events: DataFrame, inventory: DataFrame, offsets: DataFrame) -> DataFrame:
    """``(topic, value, reason)`` of all messages that change no state, as they came."""

    def row(df: DataFrame, topic: str, reason: Column) -> DataFrame:
        return df.where(reason.isNotNull()).select(F.lit(topic).alias("topic"), F.col("raw").alias("value"), reason.alias("reason"))

    unreadable = F.when(F.col("parse_error"), "unreadable")
    unknown = unreadable.when(F.col("bit_offset").isNull(), "unknown item")
    return row(events, "user_events", unreadable).unionByName(row(placed(inventory, offsets), "inventory", unknown))


def run_streams(
    spark: SparkSession,
    user_values: DataFrame,
    inventory_values: DataFrame,
    out: str,
    checkpoint: str,
    offsets: DataFrame,
    trigger: dict | None = None,
) -> dict[str, StreamingQuery]:
    """Start the three branches on two streams of JSON ``value`` rows.

    ``offsets(item_id, bit_offset)`` names each item's place in the stock bitmap. Messages that
    cannot be read, and inventory of items without a place, go to the ``rejected`` folder with
    their raw value and the reason.
    """
    use_rocksdb(spark)
    events = parse_events(user_values.withColumn("raw", F.col("value")))
    inventory = parse_inventory(inventory_values.withColumn("raw", F.col("value")))
    good, stock = events.where(~F.col("parse_error")), inventory.where(~F.col("parse_error"))
    branches = {
        "clicks": click_branch(good),
        "sessions": session_branch(good),
        "stock": stock_branch(stock, offsets),
        "rejected": rejected_branch(events, inventory, offsets),
    }
    return {
        name: start(df, f"{out}/{name}", f"{checkpoint}/{name}", trigger) for name, df in branches.items()
    }


def read_commands(spark: SparkSession, out: str, names=("clicks", "sessions", "stock"), each: bool = True) -> DataFrame:
    """All commands written so far, in a repeatable order; without ``each``, a run of equal writes is its last one."""
    parts = [spark.read.option("mergeSchema", each).parquet(f"{out}/{name}") for name in names]
    parts = [cmd.each_write(part) if each else part.drop(*cmd.RUN_COLUMNS) for part in parts]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return cmd.sequenced(rows)


def fold_commands(
    spark: SparkSession, out: str, state: str, checkpoint: str, as_of: Column | None = None, names=("clicks", "sessions", "stock")
) -> DataFrame:
    """Fold the commands written since the last call into the stored state, and return it.

    The state is a folder of versions; each version is the one before with one batch of commands
    applied, and without what has expired by ``as_of``. The commands are read as a stream, whose
    checkpoint knows which files are folded; a batch that is repeated after a failure overwrites
    its own version. So a reader opens one version instead of all commands ever written.
    """
    kind = spark.read.parquet(f"{out}/{names[0]}").schema
    stream = None
    for name in names:
        part = spark.readStream.schema(kind).parquet(f"{out}/{name}")
        stream = part if stream is None else stream.unionByName(part)

    def fold(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{state}/version={number - 1}") if number else None
        new, _ = cmd.apply_commands(cmd.sequenced(batch), old)
        if as_of is not None:
            new = new.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
        new.write.mode("overwrite").parquet(f"{state}/version={number}")
        spark.createDataFrame([(number,)], "number bigint").write.mode("append").parquet(f"{state}_versions")

    running = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    newest = spark.read.parquet(f"{state}_versions").agg(F.max("number")).first()[0]
    return spark.read.parquet(f"{state}/version={newest}")


def stream_state(spark: SparkSession, out: str, as_of: Column | None = None) -> DataFrame:
    """State after the commands written so far."""
    state, _ = cmd.apply_commands(read_commands(spark, out, each=False))
    return state if as_of is None else cmd.live_state(state, as_of)
