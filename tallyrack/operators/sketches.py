"""Quantile sketches that are stored per day and group, merged later, and read instead of the rows.

A sketch is a KLL sketch of doubles in a binary column ``sketch``, with ``n`` values, ``low`` and ``high`` beside
it; a few KB whatever it stands for. Sketches of many days merge into one with the same error, so a report
over a month reads one small row per day and group. Null and NaN values take no part.

Answers are values of the data whose rank is right to within ``rank_bound``; ``serving.percentiles``
is the exact way, which reads the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger is finer and larger: about 3 KB at 200, 9 KB at 800.
K = 800


def rank_bound(k: int = K, sure: float = 2.0) -> float:
    """How far the rank of an answer may be off, as a share of all values.

    ``sure`` = 1 holds in 99 of 100 answers, 2 in all but one in some millions. The figures are those
    published for this kind of sketch.
    """
    return sure * 2.296 / k**0.9723


def _value(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v), v)


def sketched(df: DataFrame, value: str, by: list[str], k: int = K) -> DataFrame:
    """``(by, sketch, n, low, high)``: one row per group with a value. Rows fold into sketches before the shuffle."""
    rows = df.select(*by, _value(value).alias("_v")).where(F.col("_v").isNotNull())
    return rows.groupBy(*by).agg(
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"),
        F.count("*").alias("n"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
    )


def merged(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Stored sketches -> one per group of ``by``, fewer columns than they were made for."""
    return sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def quantile(p: float, sketch: str = "sketch") -> Column:
    """The value at share ``p`` of the values in a sketch."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(p)))


#: Ranks at which a sketch is read to place a value that is not a literal.
GRID = tuple((i + 0.5) / 200 for i in range(200))


def rank(value: Column, sketch: str = "sketch") -> Column:
    """Share of the values in a sketch up to ``value``, to within ``rank_bound`` and one part in 200.

    The function that reads a rank takes literals only, so the value is placed among 200 quantiles.
    """
    points = F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*[F.lit(p) for p in GRID]))
    return F.size(F.filter(points, lambda x: x <= value)) / F.lit(float(len(GRID)))


def quantiles(sketches: DataFrame, ps: tuple[float, ...], by: list[str]) -> DataFrame:
    """``(by, p, value, rows)``, the columns of ``serving.percentiles``."""
    points = F.array(*[F.struct(F.lit(float(p)).alias("p"), quantile(p).alias("value")) for p in ps])
    return sketches.select(*by, "n", F.explode(points).alias("at")).select(*by, "at.p", "at.value", F.col("n").alias("rows"))


# Latency ---------------------------------------------------------------------


def latency_day(log: DataFrame, k: int = K) -> DataFrame:
    """``(date, tier, sketch, n, low, high, requests, errors, first_ts, last_ts)`` of a serving log.

    One row per day and tier, to be stored by date (``sources.events.write_partition``); an empty tier
    counts as ``unknown``. A request without a duration counts as a request and not in the sketch.
    """
    tier = F.coalesce(F.nullif(F.col("tier"), F.lit("")), F.lit("unknown"))
    rows = log.select(F.to_date("ts").alias("date"), tier.alias("tier"), "ts", _value("duration_ms").alias("_v"), "error")
    return rows.groupBy("date", "tier").agg(
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"),
        F.count("_v").alias("n"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
        F.count("*").alias("requests"),
        F.count_if("error").alias("errors"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def latency_from_sketches(stored: DataFrame, by: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99), k: int = K) -> DataFrame:
    """The latency report of ``serving.latency_report`` from stored days, percentiles from sketches."""
    held = merged(stored.where(F.col("n") > 0), by, k).withColumnRenamed("n", "measured")
    seconds = (F.unix_micros(F.max("last_ts")) - F.unix_micros(F.min("first_ts"))) / 1e6
    totals = stored.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        (F.sum("requests") / F.greatest(seconds, F.lit(1.0))).alias("requests_per_second"),
        (F.sum("errors") / F.sum("requests") * 100).alias("error_percent"),
    )
    match = F.lit(True)
    for c in by:
        match = match & F.col(f"_{c}").eqNullSafe(F.col(c))
    # one row per group on either side
    return totals.join(held, match, "left").select(
        *[F.col(f"_{c}").alias(c) for c in by], "requests", "errors", "requests_per_second", "error_percent",
        F.col("high").alias("max_ms"), *[quantile(p).alias(f"p{round(p * 100)}_ms") for p in ps],
    )


# Drift -----------------------------------------------------------------------


def feature_day(features: DataFrame, columns: list[str], date: Column, k: int = K) -> DataFrame:
    """``(date, column, sketch, n, low, high, nulls)``: one row per column of a feature table, to be stored by date."""
    typed = features.select(*[_value(c).alias(c) for c in columns]).unpivot([], columns, "column", "value")
    return typed.groupBy("column").agg(
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"),
        F.count("value").alias("n"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
    ).withColumn("date", date)


def drift_of(before: DataFrame, after: DataFrame, ps: tuple[float, ...] = (0.1, 0.5, 0.9), tolerance: float = 0.2) -> DataFrame:
    """``(column, p, before, after, change, shift, drifted)`` from two stored days; no feature row is read.

    ``change`` is the relative change of the percentile; ``shift`` is how far the old percentile's rank
    has moved among the new values, which also tells where percentiles are 0 or far apart. A column
    that one day lacks has drifted.
    """
    old = before.where(F.col("n") > 0).select("column", F.col("sketch").alias("_old"))
    new = after.where(F.col("n") > 0).select("column", F.col("sketch").alias("_new"))
    both = old.join(new, "column", "full")  # one row per column
    points = [F.struct(F.lit(float(p)).alias("p"), quantile(p, "_old").alias("before"), quantile(p, "_new").alias("after")) for p in ps]
    found = both.select("column", F.inline(F.array(*points)), "_new")
    change = F.abs(F.col("after") - F.col("before")) / F.greatest(F.abs("before"), F.lit(1e-9))
    return found.select(
        "column", "p", "before", "after", change.alias("change"), (rank(F.col("before"), "_new") - F.col("p")).alias("shift"),
        F.coalesce(change > tolerance, F.lit(True)).alias("drifted"),
    )


# Error -----------------------------------------------------------------------


def rank_errors(df: DataFrame, value: str, answers: DataFrame, by: list[str]) -> DataFrame:
    """``(by, p, value, rows, error)``: how far each answer's true rank is from ``p``, by reading the rows.

    An answer covers the ranks of all rows equal to it; the error is 0 if ``p`` is among them. Rows fold to
    one row per (group, value) first. ``answers`` has at most some percentiles per group.
    """
    asked = answers.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.collect_list(F.struct("p", F.col("value").alias("v"))).alias("_asked"))
    counts = df.select(*by, _value(value).alias("_v")).where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    match = F.lit(True)
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = counts.join(asked, match).select(*by, "_v", "_n", F.explode("_asked").alias("_a"))
    ranks = met.groupBy(*by, F.col("_a.p").alias("p"), F.col("_a.v").alias("value")).agg(
        (F.sum(F.when(F.col("_v") < F.col("_a.v"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("_below"),
        (F.sum(F.when(F.col("_v") <= F.col("_a.v"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("_upto"),
        F.sum("_n").alias("rows"),
    )
    error = F.greatest(F.col("_below") - F.col("p"), F.col("p") - F.col("_upto"), F.lit(0.0))
    return ranks.select(*by, "p", "value", "rows", error.alias("error"))
