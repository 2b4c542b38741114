"""Dense global numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.session import cut_lineage

_IN_PARTITION = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the global order of the ``order`` columns.

    One range shuffle sorts the rows. The sorted rows are checkpointed, so that counting them
    and labelling them sees the same partitions even after a lost executor; then every
    partition adds the number of rows before it (one row per partition).
    """
    slot = F.monotonically_increasing_id()
    rows = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("slot", slot)
        .select("*", F.shiftright("slot", 33).alias("part"))
    )
    rows = cut_lineage(rows)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("part")
        .agg(F.count("*").alias("part_rows"))
        .select("part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("start"))
    )
    # one row per shuffle partition, so the side is bounded by the partition count
    return (
        rows.join(F.broadcast(starts), "part")
        .withColumn(name, F.col("start") + F.col("slot").bitwiseAND(F.lit(_IN_PARTITION)))
        .drop("slot", "part", "start")
    )
