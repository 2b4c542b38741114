"""Zero-delay watermarks and the count of late rows."""

from pyspark.sql import functions as F

from tallyrack.streaming import job, progress, windows
from tests.helpers import at, rows
from tests.test_streaming import feed, stream


def _run(spark, folder, delay):
    events = windows.watermarked(stream(spark, folder / "in"), delay)
    counts = events.groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("n"))
    flat = counts.select("user_id", F.col("window.start").alias("start"), "n")
    query = job.start(flat, str(folder / f"out{delay[0]}"), str(folder / f"cp{delay[0]}"))
    query.awaitTermination()
    return spark.read.parquet(str(folder / f"out{delay[0]}")), progress.batches(spark, query)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    job.use_rocksdb(spark)
    feed(spark, tmp_path / "in", 0, [("1", "u", "click", at(0)), ("2", "u", "click", at(62))])
    # rows are dropped by the watermark that the batch before had
    feed(spark, tmp_path / "in", 1, [("3", "u", "click", at(63))])
    # the first minute is closed for a zero delay and still open for five seconds
    feed(spark, tmp_path / "in", 2, [("4", "u", "click", at(30)), ("5", "v", "click", at(31)), ("6", "u", "click", at(70))])
    feed(spark, tmp_path / "in", 3, [("7", "u", "click", at(500))])
    strict, seen = _run(spark, tmp_path, "0 seconds")
    assert rows(strict, "user_id", "start", "n") == [("u", at(0), 1), ("u", at(60), 3)]
    assert seen.agg(F.sum("dropped_rows"), F.sum("input_rows")).first() == (2, 7)
    patient, seen = _run(spark, tmp_path, "5 seconds")
    assert rows(patient, "user_id", "start", "n") == [("u", at(0), 2), ("u", at(60), 3), ("v", at(0), 1)]
    assert seen.agg(F.sum("dropped_rows")).first()[0] == 0
