"""Event lake: partitioned reads, partition overwrites, archive."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack import schemas

_LAKE = T.StructType([*schemas.EVENT.fields, T.StructField("date", T.DateType())])


def read_events(
    spark: SparkSession,
    root: str,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
    schema: T.StructType = _LAKE,
) -> DataFrame:
    """Events with ``since <= ts < until`` from a ``date=`` partitioned folder.

    The date filter prunes folders, the time filter reaches the Parquet scan.
    """
    df = spark.read.schema(schema).parquet(root)
    if since is not None:
        df = df.where((F.col("date") >= F.lit(since.date())) & (F.col("ts") >= F.lit(since)))
    if until is not None:
        df = df.where((F.col("date") <= F.lit(until.date())) & (F.col("ts") < F.lit(until)))
    return df


def read_day(spark: SparkSession, root: str, day: dt.date) -> DataFrame:
    """The events of one date partition."""
    return spark.read.schema(_LAKE).parquet(root).where(F.col("date") == F.lit(day))


def read_slice(spark: SparkSession, root: str, now: dt.datetime, hours: int = 4) -> DataFrame:
    """The events of the last ``hours`` before ``now``."""
    return read_events(spark, root, now - dt.timedelta(hours=hours), now)


def take_slice(spark: SparkSession, root: str, slices: str, checkpoint: str, schema: T.StructType = _LAKE, files_per_batch: int | None = None) -> list[int]:
    """Move the cursor over the lake: store what has arrived since the last call, whatever its event time.

    The lake is read as a stream whose checkpoint knows the files taken, so an event that reaches it days
    late is in the next slice, and none is in two. Each micro-batch is a folder ``batch=<number>``
    below ``slices``; one that is repeated after a failure overwrites its own folder. Returns the
    numbers of the batches of this call; none if nothing is new. ``read_slices`` reads them.
    """
    taken: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{slices}/batch={number}")
        taken.append(number)

    source = spark.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    running = source.parquet(root).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    running.trigger(availableNow=True).start().awaitTermination()
    return taken


def stored_batches(spark: SparkSession, slices: str) -> list[int]:
    """Numbers of the batches stored in a folder of slices."""
    try:
        held = spark.read.schema(T.StructType([T.StructField("batch", T.LongType())])).parquet(slices)
    except AnalysisException:  # no batch yet
        return []
    return sorted(r["batch"] for r in held.select("batch").distinct().collect())


def read_slices(spark: SparkSession, slices: str, numbers: list[int], schema: T.StructType = _LAKE) -> DataFrame:
    """The events of the batches that ``take_slice`` stored; no rows for no batches."""
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{slices}/batch={n}" for n in numbers])


def write_partition(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """Overwrite the partitions that occur in ``df`` and leave the others."""
    if not partition_cols:
        df.write.mode("overwrite").parquet(path)
        return
    writer = _by_partition(df, partition_cols).write.mode("overwrite")
    writer.partitionBy(*partition_cols).option("partitionOverwriteMode", "dynamic").parquet(path)


def _by_partition(df: DataFrame, partition_cols: list[str]) -> DataFrame:
    """Bring rows of a folder together, in files of good size: large folders get several."""
    return df.hint("rebalance", *partition_cols)


def write_counted(
    df: DataFrame,
    path: str,
    partition_cols: list[str] | None = None,
    metrics: dict[str, Column] | None = None,
) -> dict:
    """Overwrite and return counts taken during the write, in the same pass."""
    seen = Observation("written")
    counts = metrics or {"rows": F.count(F.lit(1))}
    write_partition(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), path, partition_cols)
    return dict(seen.get)


def with_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date("ts"))


def archive(df: DataFrame, path: str, checkpoint: str | None = None):
    """Append raw events to the lake by date; a stream returns its running query."""
    dated = with_date(df)
    if df.isStreaming:
        return (
            dated.writeStream.format("parquet")
            .partitionBy("date")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    _by_partition(dated, ["date"]).write.mode("append").partitionBy("date").parquet(path)
    return None
