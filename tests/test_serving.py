import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrack.operators import serving
from tallyrack.operators.quality import Rule, drift, quality
from tallyrack.plans.report import serving_report
from tests.helpers import at, rows


def nearest_rank(values, p):
    values = sorted(values)
    return values[min(int(len(values) * p), len(values) - 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_equal_the_sorted_position(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "a": list(rng.exponential(20, 500)),
        "b": [float(x) for x in rng.integers(-3, 4, 300)],
        "c": [7.25],
        "d": [5.0] * 40 + list(rng.normal(0, 1e-6, 40)),
        None: list(rng.lognormal(0, 5, 60)),
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, duration_ms double")
    ps = (0.0, 0.1, 0.5, 0.95, 0.99, 1.0)
    found = {(r.g, r.p): (r.value, r["rows"]) for r in serving.percentiles(df, ps, ["g"]).collect()}
    assert found == {(g, p): (nearest_rank(vs, p), len(vs)) for g, vs in groups.items() for p in ps}


def test_percentiles_without_the_broadcast(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("duration_ms"))
    want = rows(serving.percentiles(df, (0.5,), ["g"]))
    monkeypatch.setattr(serving, "MAX_BROADCAST_ROWS", 0)
    assert rows(serving.percentiles(df, (0.5,), ["g"])) == want
    assert want == [(g, 0.5, 500.0 + g, 200) for g in range(5)]


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 3.0, 8.0, 15.0, 30.0, 70.0, 500.0)], "duration_ms double")
    hist = serving.histogram(df)
    assert [r["count"] for r in hist.orderBy("le").collect()] == [2, 3, 4, 5, 6, 7, 8]
    assert serving.histogram_quantile(hist, 0.5).first().value == pytest.approx(10.0)
    assert serving.histogram_quantile(hist, 0.25).first().value == pytest.approx(1.0)
    assert serving.histogram_quantile(hist, 0.99).first().value == 100.0
    published = [(0.001, 850), (0.005, 40364), (0.01, 94949), (0.02, 124153), (0.05, 144872), (0.1, 149842), (math.inf, 150437)]
    sample = spark.createDataFrame(published, "le double, count bigint")
    want = 0.005 + 0.005 * (150437 * 0.5 - 40364) / (94949 - 40364)
    assert serving.histogram_quantile(sample, 0.5).first().value == pytest.approx(want)


LOG = "ts timestamp, tier string, duration_ms double, error boolean, load int"


def test_shares_and_unknown_tier(spark):
    log = spark.createDataFrame([("tier1_precomputed",)] * 3 + [("",), (None,)], "tier string")
    assert rows(serving.tier_shares(log)) == [("tier1_precomputed", 3, 0.6), ("unknown", 2, 0.4)]


def test_targets_by_phase(spark):
    log = [(at(i), "tier1_precomputed", 50.0, False, 100) for i in range(100)]
    log += [(at(i), "fallback_popular" if i % 2 else "tier1_precomputed", 1500.0, i == 0, 5000) for i in range(100)]
    found = {(r.phase, r.metric): (r.value, r.passed) for r in serving.slo_report(spark.createDataFrame(log, LOG)).collect()}
    assert found["baseline", "p95"] == (50.0, True)
    assert found["sustained", "p95"] == (1500.0, False)
    assert found["sustained", "fallback_rate"] == (0.5, True)
    assert found["cdn_failure", "p99"] == (None, False)  # nothing measured
    assert found["all", "error_rate"] == (1 / 200, True)


def test_phases(spark):
    df = spark.createDataFrame([(500,), (501,), (2500,), (2501,)], "load int")
    assert [r[0] for r in df.select(serving.load_phase(F.col("load"))).collect()] == ["baseline", "cdn_failure", "cdn_failure", "sustained"]
    stages = df.select(serving.load_phase(F.col("load") * 20, serving.RAMP_STAGES))
    assert [r[0] for r in stages.collect()] == ["10k", "50k", "50k", "100k"]


def test_alerts_need_an_unbroken_run(spark):
    minutes = [0, 1, 2, 3, 4, 6, 7, 8, 9]  # minute 5 has no data
    series = [("p99_ms", at(60 * m), 150.0) for m in minutes] + [("error_rate", at(60 * m), 0.02) for m in (0, 1, 4)]
    found = serving.alerts(spark.createDataFrame(series, "metric string, window_start timestamp, value double"))
    assert rows(found, "metric", "severity", "started", "windows") == [
        ("error_rate", "critical", at(0), 2), ("p99_ms", "warning", at(0), 5),
    ]


def test_incident_compare(spark):
    log = [(at(i), "tier1_precomputed", 10.0, False, 0) for i in range(4)]
    log += [(at(100 + i), "fallback_popular" if i < 3 else "tier2_rerank", 90.0, i == 0, 0) for i in range(4)]
    found = {r.phase: r for r in serving.phase_compare(spark.createDataFrame(log, LOG), F.lit(at(50))).collect()}
    assert (found["before"].error_rate, found["before"].cache_hit_rate, found["before"].p99_ms) == (0.0, 1.0, 10.0)
    assert (found["after"].error_rate, found["after"].cache_hit_rate, found["after"].p99_ms) == (0.25, 0.25, 90.0)


def test_report_has_every_view(spark):
    log = [(at(30 * i), "tier1_precomputed", 150.0, False, 100) for i in range(40)]
    report = serving_report(spark.createDataFrame(log, LOG))
    assert all(df.count() > 0 for df in report.values())
    row = report["latency"].first()
    assert (row.requests, row.errors, row.p50_ms, row.max_ms) == (40, 0, 150.0, 150.0)


def test_rates(spark):
    df = spark.createDataFrame([(at(0),), (at(299),), (at(300),)], "ts timestamp")
    assert rows(serving.rate(df)) == [(at(0), 2, 2 / 300), (at(300), 1, 1 / 300)]


def test_quality(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), (None, 5.0), ("b", None)], "k string, v double")
    rules = [Rule("k", "not_null"), Rule("v", "range", low=0.0, high=4.0), Rule("k", "unique")]
    assert rows(quality(df, rules)) == [("k", "not_null", 4, 1), ("k", "unique", 3, 1), ("v", "range", 4, 2)]


def test_drift(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    b = a.select((F.col("x") * 2).alias("x"), "y")
    found = {(r.column, r.p): r.drifted for r in drift(a, b, ["x", "y"], (0.5,)).collect()}
    assert found == {("x", 0.5): True, ("y", 0.5): False}
