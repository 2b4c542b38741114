"""What a finished stream says about late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PROGRESS = "run_id string, batch bigint, watermark string, input_rows bigint, dropped_rows bigint"


def batches(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per batch of a run: its watermark, rows read, and rows dropped for being late.

    Spark folds rows of one key and window in the map stage before it drops them, so an aggregation counts
    such a group once. A batch drops by the watermark of the batch before it. A run keeps its last ``spark.sql.streaming.numRecentProgressUpdates`` batches.
    """
    rows = [
        (
            str(p["runId"]), p["batchId"], (p["eventTime"] or {}).get("watermark"), p["numInputRows"],
            sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]),
        )
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, PROGRESS)
