"""Serving-log analytics: shares, exact percentiles, histograms, rates, targets, alerts.

A log row has ``ts, tier, duration_ms, error`` and, where a report needs it, ``load``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrack.session import cut_lineage

# Latency bounds (ms), load steps and targets of the platform.
BOUNDS_MS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0)
LOAD_PHASES = ((500, "baseline"), (2500, "cdn_failure"), (None, "sustained"))
RAMP_STAGES = ((1000, "1k"), (10000, "10k"), (50000, "50k"), (None, "100k"))
CDN_TARGETS = (
    ("baseline", "p95", "<", 100.0),
    ("baseline", "p99", "<", 200.0),
    ("cdn_failure", "p95", "<", 500.0),
    ("cdn_failure", "p99", "<", 1000.0),
    ("sustained", "p95", "<", 1000.0),
    ("sustained", "p99", "<", 2000.0),
    ("sustained", "fallback_rate", ">", 0.30),
    ("all", "error_rate", "<", 0.05),
)
RAMP_TARGETS = (
    ("1k", "p95", "<", 50.0),
    ("1k", "p99", "<", 100.0),
    ("10k", "p95", "<", 100.0),
    ("10k", "p99", "<", 200.0),
    ("50k", "p95", "<", 200.0),
    ("50k", "p99", "<", 500.0),
    ("100k", "p95", "<", 500.0),
    ("100k", "p99", "<", 1000.0),
    ("all", "error_rate", "<", 0.05),
)
ENDPOINT_TARGETS = (
    ("all", "timeout_rate", "<", 0.01),
    ("popular", "p95", "<", 50.0),
    ("popular", "p99", "<", 100.0),
    ("popular", "error_rate", "<", 0.01),
)
POPULAR_TIER = "tier0_popular"
TIER_TARGETS = (
    ("all", "tier1_rate", ">", 0.75),
    ("all", "tier2_rate", "<", 0.20),
    ("all", "tier3_rate", "<", 0.10),
    ("all", "error_rate", "<", 0.01),
)
TIER_OF_RATE = {
    "tier1_rate": "tier1_precomputed",
    "tier2_rate": "tier2_rerank",
    "tier3_rate": "tier3_inference",
    "fallback_rate": "fallback_popular",
}

#: Groups x percentiles that are sent to all tasks; more go through a shuffled join.
MAX_BROADCAST_ROWS = 100_000


def tier_shares(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests and share per tier; an empty tier counts as ``unknown``."""
    tier = F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("unknown")).alias("tier")
    keys = by or []
    counts = log.groupBy(*keys, tier).agg(F.count("*").alias("requests"))
    total = F.sum("requests").over(Window.partitionBy(*keys))  # one row per tier
    return counts.withColumn("share", F.col("requests") / total)


def _value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double, about 0.5 % wide: a few thousand in practice."""
    middle = 1_000_000
    size = F.floor(F.log2(F.abs(value)) * 128) + middle
    size = F.when(F.abs(value) == F.lit(float("inf")), F.lit(2 * middle)).otherwise(size)  # the ends
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def percentiles(
    log: DataFrame,
    ps: tuple[float, ...] = (0.5, 0.95, 0.99),
    by: list[str] | None = None,
    value: str = "duration_ms",
) -> DataFrame:
    """Exact nearest-rank percentiles: ``(by, p, value, rows)``.

    The value at position ``min(int(n * p), n - 1)`` of the sorted group. A first pass counts
    values in narrow buckets, which folds before the shuffle and finds the one bucket that
    holds each position. Infinite values sort at the ends; null and NaN take no part and don't
    count in ``rows``. A second pass sorts the distinct values of these buckets only. So no
    task sees a whole group.
    """
    keys = by or []
    rows = log.select(*keys, F.col(value).cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    rows = rows.withColumn("bucket", _value_bucket(F.col("v")))
    in_order = Window.partitionBy(*keys).orderBy("bucket")
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in ps]))
    upto = F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    targets = (
        counts.withColumn("upto", upto)
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .select("*", wanted.alias("p"))
        .withColumn("at", F.least(F.floor(F.col("total") * F.col("p")), F.col("total") - 1))
        .where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n")))
        .select(*keys, "bucket", "p", "at", "total", (F.col("upto") - F.col("n")).alias("before"))
    )
    targets = cut_lineage(targets)
    chosen = targets.select(*keys, "bucket").distinct()
    if targets.count() <= MAX_BROADCAST_ROWS:
        targets, chosen = F.broadcast(targets), F.broadcast(chosen)
    near = rows.join(chosen, _same(rows, chosen, [*keys, "bucket"]), "left_semi")
    distinct_values = near.groupBy(*keys, "bucket", "v").agg(F.count("*").alias("n"))
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("v")
    end = F.sum("n").over(in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = distinct_values.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns])
    match = F.lit(True)
    for key in [*keys, "bucket"]:
        match = match & placed[key].eqNullSafe(t[f"t_{key}"])
    local = F.col("t_at") - F.col("t_before")
    return placed.join(t, match & (local >= F.col("start")) & (local < F.col("end"))).select(
        *keys, F.col("t_p").alias("p"), F.col("v").alias("value"), F.col("t_total").alias("rows")
    )


def latency_report(log: DataFrame, by: list[str] | None = None, ps=(0.5, 0.95, 0.99)) -> DataFrame:
    """Requests, errors, rate, percentiles and maximum per group, one row each."""
    keys = by or []
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    totals = log.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if("error").alias("errors"),
        (F.count("*") / F.greatest(seconds, F.lit(1.0))).alias("requests_per_second"),
        (F.count_if("error") / F.count("*") * 100).alias("error_percent"),
        F.max("duration_ms").alias("max_ms"),
    )
    found = percentiles(log, ps, keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"p{round(p * 100)}_ms") for p in ps]
    )
    if not keys:
        # two single-row results
        return totals.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one", "left").drop("one")
    return totals.join(found, _same(totals, found, keys), "left").select(
        *[totals[c] for c in totals.columns], *[found[c] for c in found.columns if c not in keys]
    )


def histogram(log: DataFrame, bounds: tuple[float, ...] = BOUNDS_MS, by: list[str] | None = None) -> DataFrame:
    """Cumulative counts ``(by, le, count)``; ``le`` = infinity holds the total."""
    keys = by or []
    edges = [*bounds, float("inf")]
    counted = log.groupBy(*keys).agg(
        *[F.count_if(F.col("duration_ms") <= F.lit(edge)).alias(f"b{i}") for i, edge in enumerate(edges)]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(float(e)).alias("le"), F.col(f"b{i}").alias("count")) for i, e in enumerate(edges)])
    )
    return counted.select(*keys, pairs.alias("b")).select(*keys, "b.le", "b.count")


def histogram_quantile(hist: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket.

    The first bucket starts at 0. A quantile in the open last bucket gives the largest bound.
    """
    keys = by or []
    order = Window.partitionBy(*keys).orderBy("le")  # one row per bound
    whole = Window.partitionBy(*keys)
    rows = (
        hist.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0)))
        .withColumn("below", F.coalesce(F.lag("count").over(order), F.lit(0)))
        .withColumn("rank", F.max("count").over(whole) * F.lit(float(q)))
        .where(F.col("count") >= F.col("rank"))
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") == 1)
    )
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / F.nullif(
        F.col("count") - F.col("below"), F.lit(0)
    )
    value = F.when(F.col("le") == F.lit(float("inf")), F.col("low")).otherwise(
        F.coalesce(inside, F.col("le"))
    )
    empty = F.when(F.col("count") == 0, F.lit(None)).otherwise(value)
    return rows.select(*keys, F.lit(float(q)).alias("q"), empty.alias("value"))


def rate(log: DataFrame, seconds: int = 300, by: list[str] | None = None) -> DataFrame:
    """Requests per second in tumbling windows; works on batches and streams."""
    return (
        log.groupBy(*(by or []), F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(
            *(by or []),
            F.col("w.start").alias("window_start"),
            "requests",
            (F.col("requests") / F.lit(seconds)).alias("requests_per_second"),
        )
    )


def phase_compare(log: DataFrame, incident: Column) -> DataFrame:
    """Error rate, cache hit rate and p99 before and after an incident."""
    phase = F.when(F.col("ts") < incident, "before").otherwise("after")
    rows = log.withColumn("phase", phase)
    hit = F.col("tier").isin("tier1_precomputed", "tier2_rerank")
    rates = rows.groupBy("phase").agg(
        F.count("*").alias("requests"),
        (F.count_if("error") / F.count("*")).alias("error_rate"),
        (F.count_if(hit) / F.count("*")).alias("cache_hit_rate"),
    )
    p99 = percentiles(rows, (0.99,), ["phase"]).select("phase", F.col("value").alias("p99_ms"))
    return rates.join(p99, "phase", "left")


def load_phase(load: Column, steps=LOAD_PHASES) -> Column:
    """Load -> name of the first step whose bound is not exceeded."""
    name = F.lit(steps[-1][1])
    for bound, step in reversed(steps[:-1]):
        name = F.when(load <= bound, step).otherwise(name)
    return name


def slo_report(log: DataFrame, targets=CDN_TARGETS, steps=LOAD_PHASES, timeout_ms: float = 5000.0) -> DataFrame:
    """Measured value and verdict of every ``(phase, metric, op, bound)`` target.

    Phase ``all`` stands for the whole log and ``popular`` for the popular endpoint. A request of
    ``timeout_ms`` or more has timed out. A target without measurements fails. Rates come from one
    count per (load phase, tier, outcome), which is added up for the wider phases; only percentiles
    read a row once for each phase it belongs to.
    """
    phases = F.filter(
        F.array(load_phase(F.col("load"), steps), F.lit("all"), F.when(F.col("tier") == POPULAR_TIER, F.lit("popular"))),
        lambda p: p.isNotNull(),
    )
    late = (F.col("duration_ms") >= timeout_ms).alias("late")
    counts = log.groupBy(load_phase(F.col("load"), steps).alias("step"), "tier", "error", late).agg(F.count("*").alias("n"))
    wider = F.filter(F.array("step", F.lit("all"), F.when(F.col("tier") == POPULAR_TIER, F.lit("popular"))), lambda p: p.isNotNull())

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")

    rates = {name: part(F.col("tier") == tier) for name, tier in TIER_OF_RATE.items()}
    rates |= {"error_rate": part(F.col("error")), "timeout_rate": part(F.col("late"))}
    measured = counts.withColumn("phase", F.explode(wider)).groupBy("phase").agg(*[c.alias(n) for n, c in rates.items()])
    named = {phase for phase, metric, _, _ in targets if metric[0] == "p"}
    rows = log.withColumn("phase", F.explode(F.filter(phases, lambda p: p.isin(*named)))) if named else log
    long_rates = measured.unpivot("phase", list(rates), "metric", "value")
    ps = sorted({float(m[1:]) / 100 for _, m, _, _ in targets if m[0] == "p" and m[1:].isdigit()})
    values = long_rates
    if ps:
        found = percentiles(rows, tuple(ps), ["phase"])
        name = F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int").cast("string"))
        values = values.unionByName(found.select("phase", name.alias("metric"), "value"))
    spark = log.sparkSession
    wanted = spark.createDataFrame(list(targets), "phase string, metric string, op string, bound double")
    met = F.when(F.col("op") == "<", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    # the targets are a literal list; the measured side has one row per phase and metric
    return wanted.join(values, ["phase", "metric"], "left").withColumn(
        "passed", F.coalesce(met, F.lit(False))
    )


# Alerts ----------------------------------------------------------------------


@dataclass(frozen=True)
class AlertRule:
    metric: str
    bound: float
    for_seconds: int
    severity: str


# The planned alert rules that a serving log can answer.
ALERT_RULES = (
    AlertRule("p99_ms", 100.0, 300, "warning"),
    AlertRule("error_rate", 0.01, 120, "critical"),
)


def metric_series(log: DataFrame, step_seconds: int = 60) -> DataFrame:
    """``(metric, window_start, value)`` per step: p99 and error rate."""
    rows = log.withColumn("window_start", F.window("ts", f"{step_seconds} seconds")["start"])
    errors = rows.groupBy("window_start").agg((F.count_if("error") / F.count("*")).alias("value"))
    p99 = percentiles(rows, (0.99,), ["window_start"])
    return errors.select(F.lit("error_rate").alias("metric"), "window_start", "value").unionByName(
        p99.select(F.lit("p99_ms").alias("metric"), "window_start", "value")
    )


def alerts(series: DataFrame, rules=ALERT_RULES, step_seconds: int = 60) -> DataFrame:
    """Unbroken runs of windows above a bound that last long enough.

    A window without data ends a run.
    """
    spark = series.sparkSession
    table = spark.createDataFrame(
        [(r.metric, r.bound, r.for_seconds, r.severity) for r in rules],
        "metric string, bound double, for_seconds int, severity string",
    )
    breaches = series.join(F.broadcast(table), "metric").where(F.col("value") > F.col("bound"))
    keys = ["metric", "severity", "bound", "for_seconds"]
    order = Window.partitionBy(*keys).orderBy("window_start")
    step = F.floor(F.unix_seconds("window_start") / step_seconds)
    # consecutive windows keep the same difference between step and row number
    runs = breaches.withColumn("run", step - F.row_number().over(order))
    return (
        runs.groupBy(*keys, "run")
        .agg(
            F.min("window_start").alias("started"),
            F.max("window_start").alias("last_window"),
            F.count("*").alias("windows"),
            F.max("value").alias("peak"),
        )
        .where(F.col("windows") * step_seconds >= F.col("for_seconds"))
        .drop("run")
    )
