"""Update-mode streams against their batch queries, over several micro-batches, restarts and compactions."""

from pyspark.sql import functions as F

from tallyrack.operators import experiments as exp
from tallyrack.operators.features import event_counts
from tallyrack.streaming import job, upserts
from tests.helpers import at, rows
from tests.test_streaming import EVENT, feed, run, stream

KEYS = ["user_id", "event_type"]


def _events(n):
    return [(f"e{i}", f"u{i % 5}", ("click", "view")[i % 3 == 0], at(i)) for i in range(*n)]


def _counted(spark, folder, found):
    want = event_counts(spark.read.schema(EVENT).parquet(str(folder / "in" / "part*")))
    assert rows(found, *KEYS, "n") == rows(want, *KEYS, "n")


def test_running_counts_after_three_batches_a_restart_and_a_compaction(spark, tmp_path):
    path, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    job.use_rocksdb(spark)

    def go():
        upserts.start(event_counts(stream(spark, tmp_path / "in")), path, cp).awaitTermination()
        return upserts.read(spark, path, KEYS)

    for n in range(3):
        feed(spark, tmp_path / "in", n, _events((20 * n, 20 * n + 20)))
    _counted(spark, tmp_path, go())
    assert upserts.compact(spark, path, KEYS) == 2 and upserts.compact(spark, path, KEYS) == 2
    _counted(spark, tmp_path, upserts.read(spark, path, KEYS))
    feed(spark, tmp_path / "in", 3, [("late", "u1", "click", at(5)), ("new", "u9", "view", at(1))])
    _counted(spark, tmp_path, go())
    # a batch writes the changed keys alone
    assert rows(spark.read.parquet(f"{path}/batch=3"), *KEYS) == [("u1", "click"), ("u9", "view")]
    assert upserts.compact(spark, path, KEYS) == 3
    _counted(spark, tmp_path, upserts.read(spark, path, KEYS))


def test_a_repeated_batch_and_an_unfinished_base_change_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    for number, n in ((0, 1), (1, 2), (1, 2)):
        spark.createDataFrame([("a", n)], "k string, n bigint").write.mode("overwrite").parquet(f"{path}/batch={number}")
    spark.createDataFrame([("a", 99, 1)], "k string, n bigint, batch bigint").write.parquet(f"{path}_base/upto=1")  # no number written
    assert rows(upserts.read(spark, path, ["k"]), "k", "n") == [("a", 2)]
    assert upserts.compact(spark, path, ["k"]) == 1
    assert rows(upserts.read(spark, path, ["k"]), "k", "n") == [("a", 2)]


def test_exposures_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    for n in range(3):
        feed(spark, tmp_path / "in", n, [(f"e{i}", f"u{i}", "view", at(i)) for i in range(30 * n, 30 * n + 30)])
    table = spark.createDataFrame([("exp-a", "v1", 30.0), ("exp-b", "v2", 30.0)], "experiment_id string, model_version string, traffic_pct double")
    found = run(spark, exp.exposures(exp.assign_experiments(stream(spark, tmp_path / "in"), table)), tmp_path, "exposed")
    want = exp.exposures(exp.assign_experiments(spark.read.schema(EVENT).parquet(str(tmp_path / "in" / "part*")), table))
    columns = "user_id", "experiment_id", "model_version", "ts"
    assert rows(found, *columns) == rows(want, *columns) and want.where(F.col("experiment_id") == "exp-a").count() > 0
