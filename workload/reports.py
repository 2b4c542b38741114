"""Queries on the serving log and on feature quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrack.operators import features as feat
from tallyrack.operators import serving, sketches
from tallyrack.operators.quality import Rule, drift, quality
from tallyrack.plans.report import serving_report
from tallyrack.sources.events import write_partition
from tallyrack.session import cut_lineage
from workload import tables as t
from workload.registry import EV, LOG, SQL, TRADES, micros, query

SPLIT = f"TIMESTAMP '{t.SPLIT}'"


def _pct_sql(source: str, key: str, ps: tuple[float, ...], value: str = "duration_ms") -> str:
    points = " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p" for p in ps)
    return f"""(SELECT {key} AS k, p, max(v) AS value, max(n) AS rows FROM (
        SELECT {key}, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS i,
               count(*) OVER (PARTITION BY {key}) AS n FROM {source}), ({points})
      WHERE i = least(floor(n * p)::BIGINT, n - 1) GROUP BY 1, 2)"""


@query(
    f"""WITH {LOG} SELECT tier, count(*) AS requests, round(count(*) / (SELECT count(*) FROM log), 6) AS share
    FROM log GROUP BY 1"""
)
def tier_distribution(spark, sf):
    return serving.tier_shares(t.serving_log(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"WITH {LOG} SELECT k AS tier, p, value, rows FROM {_pct_sql('log', 'tier', (0.5, 0.95, 0.99))}")
def latency_percentiles(spark, sf):
    log = t.serving_log(spark, sf).withColumn("tier", F.when(F.col("tier") == "", "unknown").otherwise(F.col("tier")))
    return serving.percentiles(log, by=["tier"])


@query(
    f"""WITH {LOG}, x AS (SELECT *, 1 AS one FROM log), q AS {_pct_sql('x', 'one', (0.5, 0.95, 0.99))}
    SELECT count(*) AS requests, count(*) FILTER (error) AS errors,
      round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS requests_per_second,
      round(count(*) FILTER (error) / count(*) * 100, 6) AS error_percent, max(duration_ms) AS max_ms,
      (SELECT value FROM q WHERE p = 0.5) AS p50_ms, (SELECT value FROM q WHERE p = 0.95) AS p95_ms,
      (SELECT value FROM q WHERE p = 0.99) AS p99_ms FROM log"""
)
def latency_report(spark, sf):
    report = serving.latency_report(t.serving_log(spark, sf))
    return report.withColumn("requests_per_second", F.round("requests_per_second", 6)).withColumn(
        "error_percent", F.round("error_percent", 6)
    )


@query(
    """WITH lines AS (SELECT l_linestatus AS k, l_extendedprice FROM lineitem)
    SELECT k AS l_linestatus, p, value, rows FROM """
    + _pct_sql("lines", "k", (0.01, 0.5, 0.999), "l_extendedprice")
)
def price_percentiles(spark, sf):
    """Exact percentiles where nearly every value is different."""
    return serving.percentiles(t.table(spark, sf, "lineitem"), (0.01, 0.5, 0.999), ["l_linestatus"], "l_extendedprice")


@query(
    """WITH lines AS (SELECT l_linestatus AS k, CASE WHEN l_orderkey % 7 = 0 THEN 'infinity'::DOUBLE
        WHEN l_orderkey % 5 = 0 THEN '-infinity'::DOUBLE ELSE l_extendedprice END AS v FROM lineitem)
    SELECT k AS l_linestatus, p, value, rows FROM """
    + _pct_sql("lines", "k", (0.01, 0.5, 0.999), "v")
)
def percentiles_with_infinity(spark, sf):
    """Infinite values sort at the ends; missing ones and those that are no number take no part."""
    infinity = F.lit(float("inf"))
    key, price = F.col("l_orderkey"), F.col("l_extendedprice")
    odd = F.when(key % 7 == 0, infinity).when(key % 5 == 0, -infinity).otherwise(price)
    lines = t.table(spark, sf, "lineitem").select("l_linestatus", odd.alias("v"))
    nothing = lines.select("l_linestatus", F.when(F.rand(1) < 0.5, F.lit(float("nan"))).alias("v"))
    return serving.percentiles(lines.unionByName(nothing), (0.01, 0.5, 0.999), ["l_linestatus"], "v")


_BOUNDS = ", ".join(f"{b}::DOUBLE" for b in serving.BOUNDS_MS) + ", 'infinity'::DOUBLE"
_HIST = f"""hist AS (SELECT tier, le, count(*) FILTER (duration_ms <= le) AS count
  FROM log, (SELECT unnest([{_BOUNDS}]) AS le) GROUP BY 1, 2)"""


@query(f"WITH {LOG}, {_HIST} SELECT tier, le::VARCHAR AS le, count FROM hist")
def latency_histogram(spark, sf):
    log = t.serving_log(spark, sf).withColumn("tier", F.when(F.col("tier") == "", "unknown").otherwise(F.col("tier")))
    hist = serving.histogram(log, by=["tier"])
    le = F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string"))
    return hist.select("tier", le.alias("le"), "count")


@query(
    f"""WITH {LOG}, {_HIST}, edges AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(count) OVER w, 0) AS below,
      max(count) OVER (PARTITION BY tier) AS total FROM hist WINDOW w AS (PARTITION BY tier ORDER BY le)),
    asked AS (SELECT edges.*, q, total * q AS want FROM edges, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q)),
    hit AS (SELECT * FROM asked WHERE count >= want QUALIFY row_number() OVER (PARTITION BY tier, q ORDER BY le) = 1)
    SELECT tier, q, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (want - below) / (count - below) END, 6)
      AS value FROM hit"""
)
def histogram_quantiles(spark, sf):
    log = t.serving_log(spark, sf).withColumn("tier", F.when(F.col("tier") == "", "unknown").otherwise(F.col("tier")))
    hist = serving.histogram(log, by=["tier"])
    parts = [serving.histogram_quantile(hist, q, ["tier"]) for q in (0.5, 0.95, 0.99)]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.withColumn("value", F.round("value", 6))


@query(
    f"""WITH {LOG} SELECT (epoch_us(ts) // 300000000) * 300000000 AS window_us, count(*) AS requests,
      round(count(*) / 300, 6) AS requests_per_second FROM log GROUP BY 1"""
)
def request_rate(spark, sf):
    found = serving.rate(t.serving_log(spark, sf))
    return found.select(
        micros("window_start", "window_us"), "requests", F.round("requests_per_second", 6).alias("requests_per_second")
    )


@query(
    f"""WITH {LOG}, x AS (SELECT *, CASE WHEN ts < {SPLIT} THEN 'before' ELSE 'after' END AS phase FROM log),
    q AS {_pct_sql('x', 'phase', (0.99,))}
    SELECT phase, count(*) AS requests, round(count(*) FILTER (error) / count(*), 6) AS error_rate,
      round(count(*) FILTER (tier IN ('tier1_precomputed', 'tier2_rerank')) / count(*), 6) AS cache_hit_rate,
      max(value) AS p99_ms FROM x JOIN q ON k = phase GROUP BY 1"""
)
def phase_compare(spark, sf):
    found = serving.phase_compare(t.serving_log(spark, sf), F.lit(t.SPLIT))
    return found.withColumn("error_rate", F.round("error_rate", 6)).withColumn(
        "cache_hit_rate", F.round("cache_hit_rate", 6)
    )


def _slo_sql(targets, steps=serving.LOAD_PHASES, tier: str = "tier", late: float = 5000.0) -> str:
    named = " ".join(f"WHEN load <= {bound} THEN '{name}'" for bound, name in steps[:-1]) + f" ELSE '{steps[-1][1]}'"
    rows = ", ".join(f"('{p}', '{m}', '{o}', {b}::DOUBLE)" for p, m, o, b in targets)
    return f"""WITH {LOG}, phased AS (SELECT * REPLACE ({tier} AS tier), CASE {named} END AS phase FROM log),
    x AS (SELECT * FROM phased UNION ALL BY NAME SELECT * REPLACE ('all' AS phase) FROM phased
        UNION ALL BY NAME SELECT * REPLACE ('popular' AS phase) FROM phased WHERE tier = 'tier0_popular'),
    r AS (SELECT phase, count(*) FILTER (tier = 'tier1_precomputed') / count(*) AS tier1_rate,
        count(*) FILTER (tier = 'tier2_rerank') / count(*) AS tier2_rate,
        count(*) FILTER (tier = 'tier3_inference') / count(*) AS tier3_rate,
        count(*) FILTER (tier = 'fallback_popular') / count(*) AS fallback_rate,
        count(*) FILTER (duration_ms >= {late}) / count(*) AS timeout_rate,
        count(*) FILTER (error) / count(*) AS error_rate FROM x GROUP BY 1),
    m AS (SELECT phase, metric, value FROM (UNPIVOT r ON tier1_rate, tier2_rate, tier3_rate, fallback_rate, error_rate, timeout_rate
        INTO NAME metric VALUE value)
      UNION ALL SELECT k, 'p' || round(p * 100)::INT, value FROM {_pct_sql('x', 'phase', (0.95, 0.99))}),
    t(phase, metric, op, bound) AS (VALUES {rows})
    SELECT phase, metric, op, bound, round(value, 6) AS value,
      coalesce(CASE op WHEN '<' THEN value < bound ELSE value > bound END, false) AS passed
    FROM t LEFT JOIN m USING (phase, metric)"""


@query(_slo_sql(serving.CDN_TARGETS))
def slo_report(spark, sf):
    return serving.slo_report(t.serving_log(spark, sf)).withColumn("value", F.round("value", 6))


@query(_slo_sql(serving.TIER_TARGETS))
def tier_targets(spark, sf):
    found = serving.slo_report(t.serving_log(spark, sf), serving.TIER_TARGETS)
    return found.withColumn("value", F.round("value", 6))


@query(_slo_sql(serving.RAMP_TARGETS, ((200, "1k"), (400, "10k"), (600, "50k"), (None, "100k"))))
def ramp_targets(spark, sf):
    """Targets of the load ramp, with stage bounds that suit the log's loads."""
    steps = tuple(zip((200, 400, 600, None), (name for _, name in serving.RAMP_STAGES)))
    found = serving.slo_report(t.serving_log(spark, sf), serving.RAMP_TARGETS, steps)
    return found.withColumn("value", F.round("value", 6))


_ENDPOINT = "CASE tier WHEN 'fallback_popular' THEN 'tier0_popular' ELSE tier END"


@query(_slo_sql(serving.ENDPOINT_TARGETS, tier=_ENDPOINT, late=80.0))
def endpoint_targets(spark, sf):
    """Timeouts, and the popular endpoint, which a part of the log's requests stands for."""
    log = t.serving_log(spark, sf).replace({"fallback_popular": serving.POPULAR_TIER}, subset=["tier"])
    return serving.slo_report(log, serving.ENDPOINT_TARGETS, timeout_ms=80.0).withColumn("value", F.round("value", 6))


_RULES = (
    serving.AlertRule("p99_ms", 60.0, 7200, "warning"),
    serving.AlertRule("error_rate", 0.2, 10_800, "critical"),
)


@query(
    f"""WITH {LOG}, x AS (SELECT *, epoch_us(ts) // 3600000000 AS h FROM log), q AS {_pct_sql('x', 'h', (0.99,))},
    series AS (SELECT 'p99_ms' AS metric, k AS h, value FROM q UNION ALL
      SELECT 'error_rate', h, count(*) FILTER (error) / count(*) FROM x GROUP BY h),
    rules(metric, bound, for_seconds, severity) AS (VALUES ('p99_ms', 60.0::DOUBLE, 7200, 'warning'),
      ('error_rate', 0.2::DOUBLE, 10800, 'critical')),
    runs AS (SELECT *, h - row_number() OVER (PARTITION BY metric ORDER BY h) AS run
      FROM series JOIN rules USING (metric) WHERE value > bound)
    SELECT metric, severity, bound, for_seconds, min(h) * 3600000000 AS started_us, max(h) * 3600000000 AS last_us,
      count(*) AS windows, round(max(value), 6) AS peak FROM runs GROUP BY metric, severity, bound, for_seconds, run
    HAVING count(*) * 3600 >= for_seconds"""
)
def alert_runs(spark, sf):
    series = serving.metric_series(t.serving_log(spark, sf), 3600)
    found = serving.alerts(series, _RULES, 3600)
    return found.select(
        "metric", "severity", "bound", "for_seconds", micros("started", "started_us"),
        micros("last_window", "last_us"), "windows", F.round("peak", 6).alias("peak"),
    )


@query(
    """SELECT 'l_quantity' AS "column", 'range' AS "check", count(*) AS rows,
      count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS failed FROM lineitem
    UNION ALL SELECT 'l_shipdate', 'not_null', count(*), count(*) FILTER (l_shipdate IS NULL) FROM lineitem
    UNION ALL SELECT 'l_orderkey', 'unique', count(*), count(*) - count(DISTINCT l_orderkey) FROM lineitem"""
)
def quality_checks(spark, sf):
    rules = [
        Rule("l_quantity", "range", low=5, high=45),
        Rule("l_shipdate", "not_null"),
        Rule("l_orderkey", "unique"),
    ]
    return quality(t.table(spark, sf, "lineitem"), rules)


_DRIFT_COLUMNS = ("total_clicks", "total_views", "total_events")


def _drift_sql() -> str:
    def half(name: str, condition: str) -> str:
        return f"""{name} AS (SELECT "column", v FROM (UNPIVOT (SELECT count(*) FILTER (event_type = 'click') AS total_clicks,
          count(*) FILTER (event_type = 'view') AS total_views, count(*) AS total_events FROM ev WHERE {condition}
          GROUP BY user_id) ON total_clicks, total_views, total_events INTO NAME "column" VALUE v))"""

    ps = (0.1, 0.5, 0.9)
    return f"""WITH {EV}, {half('b', f'ts < {SPLIT}')}, {half('a', f'ts >= {SPLIT}')},
    pb AS {_pct_sql('b', '"column"', ps, 'v')}, pa AS {_pct_sql('a', '"column"', ps, 'v')}
    SELECT pb.k AS "column", pb.p, pb.value::DOUBLE AS before, pa.value::DOUBLE AS after,
      round(abs(pa.value - pb.value) / greatest(abs(pb.value), 1e-9), 6) AS change,
      abs(pa.value - pb.value) / greatest(abs(pb.value), 1e-9) > 0.2 AS drifted
    FROM pb JOIN pa ON pb.k = pa.k AND pb.p = pa.p"""


@query(_drift_sql())
def feature_drift(spark, sf):
    events = t.events(spark, sf)
    before = feat.compute_user_features(events.where(F.col("ts") < F.lit(t.SPLIT)))
    after = feat.compute_user_features(events.where(F.col("ts") >= F.lit(t.SPLIT)))
    return drift(before, after, list(_DRIFT_COLUMNS)).withColumn("change", F.round("change", 6))


@query(
    f"""SELECT 'tiers' AS part, tier AS name, share AS value FROM ({SQL['tier_distribution']})
    UNION ALL SELECT 'targets', phase || '/' || metric, value FROM ({SQL['slo_report']})
    UNION ALL SELECT 'tier_targets', phase || '/' || metric, value FROM ({SQL['tier_targets']})"""
)
def serving_report_values(spark, sf):
    """Shares and targets out of the whole serving report."""
    report = serving_report(t.serving_log(spark, sf), 3600)
    goal = F.concat_ws("/", "phase", "metric").alias("name")
    parts = [
        report["tiers"].select(F.lit("tiers").alias("part"), F.col("tier").alias("name"), F.col("share").alias("value")),
        report["targets"].select(F.lit("targets").alias("part"), goal, "value"),
        report["tier_targets"].select(F.lit("tier_targets").alias("part"), goal, "value"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.withColumn("value", F.round("value", 6))


# Stored sketches -------------------------------------------------------------

_TIERED = "CASE WHEN tier = '' THEN 'unknown' ELSE tier END"


def _sketched_days(spark, sf):
    """One sketch per day and tier, stored by date and read back."""
    path = t.scratch(spark, "latency-days")
    write_partition(sketches.latency_day(t.serving_log(spark, sf)), path, ["date"])
    return spark.read.parquet(path)


def _tiered_log(spark, sf):
    log = t.serving_log(spark, sf).withColumn("date", F.to_date("ts"))
    return log.withColumn("tier", F.when(F.col("tier") == "", "unknown").otherwise(F.col("tier")))


_POINTS = (0.01, 0.5, 0.95, 0.99)
_ASKED_POINTS = f"(SELECT unnest({list(_POINTS)}::DOUBLE[]) AS p)"


@query(
    f"""WITH {LOG}, days AS (SELECT ts::DATE::VARCHAR AS date, {_TIERED} AS tier, count(duration_ms) AS rows FROM log GROUP BY ALL),
    spans AS (FROM days UNION ALL SELECT 'all', tier, sum(rows)::BIGINT FROM days GROUP BY tier)
    SELECT date, tier, p, rows, true AS within FROM spans, {_ASKED_POINTS}"""
)
def latency_sketches(spark, sf):
    """Percentiles of every day, and of all days, from stored sketches: is each answer's true rank near enough?"""
    stored = _sketched_days(spark, sf)
    log = _tiered_log(spark, sf)
    by_day = sketches.rank_errors(log, "duration_ms", sketches.quantiles(stored, _POINTS, ["date", "tier"]), ["date", "tier"])
    merged = sketches.merged(stored, ["tier"])
    in_all = sketches.rank_errors(log, "duration_ms", sketches.quantiles(merged, _POINTS, ["tier"]), ["tier"])
    both = by_day.withColumn("date", F.col("date").cast("string")).unionByName(in_all.withColumn("date", F.lit("all")))
    return both.select("date", "tier", "p", "rows", (F.col("error") <= sketches.rank_bound()).alias("within"))


@query(
    f"""WITH {LOG} SELECT {_TIERED} AS tier, count(*) AS requests, count(*) FILTER (error) AS errors,
      round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS requests_per_second,
      round(count(*) FILTER (error) / count(*) * 100, 6) AS error_percent, max(duration_ms) AS max_ms, true AS in_order
    FROM log GROUP BY 1"""
)
def latency_report_sketched(spark, sf):
    """The latency report of all days per tier; no log row is read for it."""
    report = sketches.latency_from_sketches(_sketched_days(spark, sf), ["tier"])
    in_order = (F.col("p50_ms") <= F.col("p95_ms")) & (F.col("p95_ms") <= F.col("p99_ms")) & (F.col("p99_ms") <= F.col("max_ms"))
    return report.select(
        "tier", "requests", "errors", F.round("requests_per_second", 6).alias("requests_per_second"),
        F.round("error_percent", 6).alias("error_percent"), "max_ms", in_order.alias("in_order"),
    )


_HALF = """SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
  count(*) AS n FROM trades WHERE ts {} TIMESTAMP '1995-06-01' GROUP BY 1"""


@query(
    f"""WITH {TRADES}, a AS ({_HALF.format('<')}), b AS ({_HALF.format('>=')})
    SELECT c AS column, p, (SELECT count(*) FROM a) AS rows_before, (SELECT count(*) FROM b) AS rows_after,
      true AS before_within, true AS after_within, true AS shift_within
    FROM (SELECT unnest(['total_clicks', 'total_views', 'total_events']) AS c), (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS p)"""
)
def drift_sketched(spark, sf):
    """Drift of user features between two periods, from one stored sketch per column and period."""
    trades = t.with_category(t.trade_events(spark, sf), spark, sf)
    columns = ["total_clicks", "total_views", "total_events"]
    border = F.lit("1995-06-01").cast("timestamp")
    parts = {
        "before": feat.compute_user_features(trades.where(F.col("ts") < border)),
        "after": feat.compute_user_features(trades.where(F.col("ts") >= border)),
    }
    # a row per user, read up to three times: the trades are joined once per period
    parts = {name: cut_lineage(features.select(*columns)) for name, features in parts.items()}
    path = t.scratch(spark, "feature-days")
    for name, features in parts.items():
        day = sketches.feature_day(features, columns, F.lit("1995-05-31" if name == "before" else "1995-06-01").cast("date"))
        write_partition(day, path, ["date"])
    stored = spark.read.parquet(path)
    days = {"before": stored.where("date = '1995-05-31'"), "after": stored.where("date = '1995-06-01'")}
    found = sketches.drift_of(days["before"], days["after"])
    bound = sketches.rank_bound()
    checked = found.select("column", "p", "before", "shift")
    for name, features in parts.items():
        rows = features.select(*columns).unpivot([], columns, "column", "v")
        errors = sketches.rank_errors(rows, "v", found.select("column", "p", F.col(name).alias("value")), ["column"])
        checked = checked.join(
            errors.select("column", "p", F.col("rows").alias(f"rows_{name}"), (F.col("error") <= bound).alias(f"{name}_within")), ["column", "p"]
        )
    # the share of new values up to each old percentile, counted
    new = parts["after"].select(*columns).unpivot([], columns, "column", "v")
    true_rank = new.join(F.broadcast(found.select("column", "p", "before")), "column").groupBy("column", "p").agg(
        (F.count_if(F.col("v") <= F.col("before")) / F.count("*")).alias("true_rank")
    )
    return checked.join(true_rank, ["column", "p"]).select(
        "column", "p", "rows_before", "rows_after", "before_within", "after_within",
        (F.abs(F.col("shift") + F.col("p") - F.col("true_rank")) <= bound + 1 / len(sketches.GRID)).alias("shift_within"),
    )
