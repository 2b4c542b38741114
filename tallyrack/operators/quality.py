"""Checks of feature tables between stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrack.operators.serving import percentiles


@dataclass(frozen=True)
class Rule:
    """``check`` is ``not_null``, ``range`` (with ``low``/``high``) or ``unique``."""

    column: str
    check: str
    low: float | None = None
    high: float | None = None


def quality(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(column, check, rows, failed)`` per rule; rows beyond the first of a value fail ``unique``."""
    aggregates = [F.count("*").alias("rows")]
    for i, rule in enumerate(rules):
        c = F.col(rule.column)
        if rule.check == "not_null":
            aggregates.append(F.count_if(c.isNull()).alias(f"f{i}"))
        elif rule.check == "range":
            out = F.lit(False)
            if rule.low is not None:
                out = out | (c < rule.low)
            if rule.high is not None:
                out = out | (c > rule.high)
            aggregates.append(F.count_if(out).alias(f"f{i}"))
        elif rule.check != "unique":
            raise ValueError(f"unknown check: {rule.check}")
    one_pass = df.agg(*aggregates)
    results = [
        F.struct(F.lit(r.column).alias("column"), F.lit(r.check).alias("check"), F.col(f"f{i}").alias("failed"))
        for i, r in enumerate(rules)
        if r.check != "unique"
    ]
    parts = []
    if results:
        parts.append(
            one_pass.select("rows", F.explode(F.array(*results)).alias("r")).select(
                "r.column", "r.check", "rows", "r.failed"
            )
        )
    for rule in rules:
        if rule.check == "unique":
            counts = df.where(F.col(rule.column).isNotNull()).groupBy(rule.column).agg(F.count("*").alias("n"))
            summed = counts.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("failed"))
            parts.append(
                summed.select(
                    F.lit(rule.column).alias("column"),
                    F.lit(rule.check).alias("check"),
                    F.coalesce("rows", F.lit(0)).alias("rows"),
                    F.coalesce("failed", F.lit(0)).alias("failed"),
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drift(
    before: DataFrame,
    after: DataFrame,
    columns: list[str],
    ps: tuple[float, ...] = (0.1, 0.5, 0.9),
    tolerance: float = 0.2,
) -> DataFrame:
    """Relative change of each column's percentiles between two tables."""

    def points(df: DataFrame, name: str) -> DataFrame:
        typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        long = typed.unpivot([], columns, "column", "value")
        return percentiles(long, ps, ["column"], "value").select("column", "p", F.col("value").alias(name))

    both = points(before, "before").join(points(after, "after"), ["column", "p"], "full")
    change = F.abs(F.col("after") - F.col("before")) / F.greatest(F.abs("before"), F.lit(1e-9))
    return both.withColumn("change", change).withColumn(
        "drifted", F.coalesce(F.col("change") > tolerance, F.lit(True))
    )
