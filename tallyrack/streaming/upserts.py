"""Streams in update mode: every batch leaves the rows that changed, readers take the newest row of each key.

A folder ``batch=n`` holds what batch n changed, so a write is as large as the change. ``compact``
folds all batches so far into one base; a reader opens the newest base and the batches after it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream's changed rows; a batch that is repeated after a failure overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _base(spark: SparkSession, path: str) -> int | None:
    """The last batch in the newest finished base."""
    try:
        return spark.read.schema("number bigint").parquet(f"{path}_bases").agg(F.max("number")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # never compacted


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct("batch", *values), "batch").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    base, changed = _base(spark, path), spark.read.option("basePath", path).parquet(path)
    changed = changed.withColumn("batch", F.col("batch").cast("bigint"))
    if base is None:
        return changed
    stored = spark.read.parquet(f"{path}_base/upto={base}")
    return stored.unionByName(changed.where(F.col("batch") > base))  # older folders are pruned


def read(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of every key, as of the batches written so far."""
    return _newest(_rows(spark, path), keys).drop("batch")


def compact(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Fold the batches so far into a new base and return its last batch. A base counts once its number is written."""
    rows = _rows(spark, path)
    last = rows.agg(F.max("batch")).first()[0]
    if last is not None and last != _base(spark, path):
        # a batch that arrives meanwhile stays out of the base and is read from its folder
        _newest(rows.where(F.col("batch") <= last), keys).write.mode("overwrite").parquet(f"{path}_base/upto={last}")
        spark.createDataFrame([(last,)], "number bigint").write.mode("append").parquet(f"{path}_bases")
    return last
