"""The given tables in the roles of this library's entities."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrack.operators.skew import salted_join
from tallyrack.session import checkpoint_dir, configure

AS_OF = dt.datetime(2024, 1, 30, 12)
SPLIT = dt.datetime(2024, 1, 20)

L, S, D, TS, I = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType()

# Declared so that no file is opened for its schema and times are read as instants, which lets
# time filters reach the scan.
SCHEMAS = {
    "events": [("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D), ("props", S)],
    "lineitem": [
        ("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I), ("l_quantity", D),
        ("l_extendedprice", D), ("l_discount", D), ("l_tax", D), ("l_returnflag", S), ("l_linestatus", S),
        ("l_shipdate", TS),
    ],
    "orders": [
        ("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D), ("o_orderdate", TS),
        ("o_orderpriority", S),
    ],
    "part": [("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I), ("p_retailprice", D)],
    "customer": [("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D), ("c_mktsegment", S)],
    "embeddings": [("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)],
}


def schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in SCHEMAS[name]])


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.schema(schema(name)).parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_events(raw: DataFrame) -> DataFrame:
    """User events: the item is ``props.k``, the session is the user."""
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        user.alias("user_id"),
        "event_type",
        k.alias("item_id"),
        (k.cast("int") % 10).cast("string").alias("category_id"),
        "ts",
        user.alias("session_id"),
        "value",
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return as_events(table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event file as a stream. The pattern matches a file or a folder of that name."""
    configure(spark)
    return as_events(spark.readStream.schema(schema("events")).parquet(f"{sf}/events.parque[t]"))


def inventory_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory events as a stream; the order line shifts the time, so that times differ."""
    configure(spark)
    raw = spark.readStream.schema(schema("lineitem")).parquet(f"{sf}/lineitem.parque[t]")
    shift = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) / 1e6
    return raw.select(
        F.col("l_partkey").cast("string").alias("item_id"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_shipdate") + F.make_dt_interval(secs=shift)).alias("ts"),
    )


def with_metadata(df: DataFrame) -> DataFrame:
    k = F.col("item_id").cast("int")
    return df.withColumn(
        "metadata",
        F.struct(
            F.when(F.col("event_type") == "view", F.concat(F.lit("q"), F.col("item_id"))).otherwise("").alias("query"),
            k.alias("position"),
            F.round(F.col("value") * 100).cast("bigint").alias("price"),
            F.when(k % 2 == 0, "search").otherwise("").alias("source"),
        ),
    )


FLAG_TYPE = {"A": "click", "N": "view", "R": "purchase"}


def trade_events(spark: SparkSession, sf: str) -> DataFrame:
    """The large event table: every order line is an event of the buyer on a part."""
    kind = F.lit(None).cast("string")
    for flag, event_type in FLAG_TYPE.items():
        kind = F.when(F.col("l_returnflag") == flag, event_type).otherwise(kind)
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        kind.alias("event_type"),
        F.col("l_shipdate").alias("ts"),
    )


def with_category(trades: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category_id"))
    return salted_join(trades, kinds, "item_id", "inner")


def catalog(spark: SparkSession, sf: str, category: str = "p_type") -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col(category).alias("category_id"),
        F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"),
    )


INVENTORY_TIES = [
    "l_orderkey", "l_linenumber", "l_suppkey", "quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus",
]


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory events; ``INVENTORY_TIES`` orders events of one item and day."""
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_returnflag") != "R").alias("in_stock"),
        F.col("l_quantity").cast("int").alias("quantity"),
        *[c for c in INVENTORY_TIES if c != "quantity"],
    )


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


def user_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector also stands for a user."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request per user with events and per customer: hits, misses and all load levels."""
    seen = table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    both = seen.select("id", F.lit("e").alias("kind")).unionByName(known.select("id", F.lit("c").alias("kind")))
    user = F.when(F.col("kind") == "e", F.col("id").cast("string")).otherwise(
        F.concat(F.lit("cust-"), F.col("id").cast("string"))
    )
    limit = (
        F.when(F.col("id") % 5 == 0, "10").when(F.col("id") % 5 == 1, "abc").when(F.col("id") % 5 == 2, "500")
        .when(F.col("id") % 5 == 3, "-3")
    )
    ratio = (
        F.when(F.col("id") % 10 == 4, 3.5).when(F.col("id") % 10 == 5, 2.0).when(F.col("id") % 10 == 6, 1.5)
        .otherwise(0.5)
    )
    return both.select(
        F.concat("kind", F.col("id").cast("string")).alias("request_id"),
        user.alias("user_id"),
        F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("id").cast("string")).alias("session_id"),
        limit.alias("limit"),
        ratio.alias("load_ratio"),
    )


EXPERIMENTS = [("exp-a", "v1", 30.0), ("exp-b", "v2", 30.0), ("exp-c", "v3", 20.0)]


def experiments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPERIMENTS, "experiment_id string, model_version string, traffic_pct double")


TIER_OF_TYPE = {
    "click": "tier1_precomputed", "view": "tier2_rerank", "purchase": "tier3_inference", "signup": "fallback_popular",
}


def serving_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a request log; errors carry no tier."""
    tier = F.lit("")
    for event_type, name in TIER_OF_TYPE.items():
        tier = F.when(F.col("event_type") == event_type, name).otherwise(tier)
    return table(spark, sf, "events").select(
        "ts",
        tier.alias("tier"),
        F.col("value").alias("duration_ms"),
        (F.col("event_type") == "error").alias("error"),
        (F.get_json_object("props", "$.k").cast("int") * 40).alias("load"),
    )
