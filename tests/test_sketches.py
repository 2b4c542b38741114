import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import sketches
from tests.helpers import at, rows

LOG = "ts timestamp, tier string, duration_ms double, error boolean"


def log(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = [(at(rng.randrange(3 * 86_400)), rng.choice(["a", "b", "", None]), rng.choice([rng.expovariate(0.03), 7.0, 7.0]), rng.random() < 0.1) for _ in range(n)]
    rows += [(at(5), "a", None, True), (at(5), "a", float("nan"), False), (at(5), "only-null", None, False)]
    return rows, spark.createDataFrame(rows, LOG).repartition(5)


def true_error(values, p, answer):
    below, upto = sum(v < answer for v in values) / len(values), sum(v <= answer for v in values) / len(values)
    return max(0.0, below - p, p - upto)


@pytest.mark.parametrize("k", [50, 800])
def test_answers_of_merged_days_stay_within_the_bound(spark, k):
    rows, df = log(spark)
    days = sketches.latency_day(df, k)
    for r in sketches.quantiles(sketches.merged(days.where("n > 0"), ["tier"], k), (0.0, 0.1, 0.5, 0.99, 1.0), ["tier"]).collect():
        mine = [v for _, tier, v, _ in rows if (tier or "unknown") == r["tier"] and v is not None and v == v]
        assert r["rows"] == len(mine) and r["value"] in mine
        assert true_error(mine, r["p"], r["value"]) <= sketches.rank_bound(k)


def test_report_from_stored_days(spark):
    rows, df = log(spark)
    got = {r["tier"]: r for r in sketches.latency_from_sketches(sketches.latency_day(df), ["tier"]).collect()}
    assert set(got) == {"a", "b", "unknown", "only-null"}
    mine = [r for r in rows if r[1] == "a"]
    assert (got["a"]["requests"], got["a"]["errors"]) == (len(mine), sum(r[3] for r in mine))
    assert got["a"]["max_ms"] == max(r[2] for r in mine if r[2] is not None and r[2] == r[2])
    assert (got["only-null"]["requests"], got["only-null"]["p99_ms"]) == (1, None)
    assert sketches.latency_from_sketches(sketches.latency_day(df.limit(0)), ["tier"]).count() == 0


def test_days_fold_before_the_shuffle(spark):
    plan = sketches.sketched(log(spark)[1], "duration_ms", ["tier"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_kll_sketch_agg_double" in plan


def test_rank_errors_against_rows(spark):
    rows, df = log(spark, 300)
    answers = spark.createDataFrame([("a", 0.5, 7.0), ("a", 0.9, 7.0), ("b", 0.1, 1e9), (None, 0.5, 3.0)], "tier string, p double, value double")
    for r in sketches.rank_errors(df, "duration_ms", answers, ["tier"]).collect():
        mine = [v for _, tier, v, _ in rows if tier == r["tier"] and v is not None and v == v]
        assert r["rows"] == len(mine) and r["error"] == pytest.approx(true_error(mine, r["p"], r["value"]))


def test_drift(spark):
    rng = random.Random(3)
    old = spark.createDataFrame([(rng.gauss(10, 2), 0.0, 1.0) for _ in range(2000)], "a double, zero double, gone double")
    new = spark.createDataFrame([(rng.gauss(14, 2), 0.0) for _ in range(1500)], "a double, zero double").withColumn("fresh", F.lit(None).cast("double"))
    days = [sketches.feature_day(df, df.columns, F.lit(d).cast("date")) for df, d in ((old, "2026-01-01"), (new, "2026-01-02"))]
    found = {(r["column"], r["p"]): r for r in sketches.drift_of(*days).collect()}
    assert found["a", 0.5]["drifted"] and found["a", 0.5]["shift"] < -0.4
    assert not found["zero", 0.5]["drifted"]
    assert found["gone", 0.5]["drifted"] and ("fresh", 0.5) not in found  # a column of nulls has no sketch to compare
    assert {r["column"]: r["nulls"] for r in days[1].collect()} == {"a": 0, "zero": 0, "fresh": 1500}


def test_the_drift_query_joins_trades_once_per_period(spark, tmp_path):
    from workload import tables as t
    from workload.reports import drift_sketched

    day = [at(0, dt.datetime(1995, month, 1)) for month in (5, 7)]
    made = {
        "part": [(1, "p", "Brand#1", "SMALL", 1, 901.0)],
        "orders": [(i, i % 9, "O", 1.0, day[0], "1") for i in range(40)],
        "lineitem": [(i, 1, 1, n, 1.0, 1.0, 0.0, 0.0, "AN"[n], "O", day[i % 2]) for i in range(40) for n in (0, 1)],
    }
    for name, lines in made.items():
        spark.createDataFrame(lines, t.schema(name)).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = drift_sketched(spark, str(tmp_path))
    # the written user features are read, not the trades
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "column", "rows_before", "rows_after")[0] == ("total_clicks", 9, 9)
