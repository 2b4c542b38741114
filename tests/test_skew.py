"""Hot keys: the split ways give the rows of the plain ways."""

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import skew
from tallyrack.operators.numbering import number_rows
from tests.helpers import rows


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.range(900).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k99", 4)], "key string, value int")
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_join(sides, how):
    left, right = sides
    want = rows(left.join(right, "key", how))
    assert rows(skew.salted_join(left, right, "key", how, hot_rows=10)) == want
    assert rows(skew.salted_join(left, right, "key", how)) == want
    assert rows(skew.adaptive_join(left, right, "key", how)) == want


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_left_side_of_keys_alone(sides, how):
    left, right = sides
    keys = left.select("key")
    want = rows(keys.join(right, "key", how))
    for hot_rows in (1, 7, 10**6):
        assert rows(skew.salted_join(keys, right, "key", how, hot_rows=hot_rows)) == want


def test_there_is_no_limit_on_parts(spark):
    many = spark.range(30_000).select(F.lit("hot").alias("key"), F.col("id").alias("row"))
    assert rows(skew.hot_keys(many, "key", 10)) == [("hot", 3000)]


def test_hot_rows_land_in_many_parts(spark, sides):
    left, right = sides
    assert rows(skew.hot_keys(left, "key", 100)) == [("hot", 3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.salted_join(left, right, "key", "left", hot_rows=10).where("key = 'hot'")
        assert joined.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lag_over_buckets(spark):
    from pyspark.sql import Window

    df = spark.range(500).select(
        (F.col("id") % 3).alias("key"),
        F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1000))).alias("ts"),
        F.col("id").alias("tie"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0).alias("value"),
    )
    plain = df.withColumn("previous", F.lag("value").over(Window.partitionBy("key").orderBy("ts", "tie")))
    for width in (1, 30, 400, 10_000):
        assert rows(skew.lag_by_bucket(df, "key", "ts", ["tie"], "value", width), *plain.columns) == rows(plain)


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("name"))
    found = number_rows(df, ["name"]).orderBy("name").collect()
    assert [r.position for r in found] == list(range(5000))
    assert number_rows(df.limit(0), ["name"]).count() == 0
