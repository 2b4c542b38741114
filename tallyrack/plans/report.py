"""The serving-log report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyrack.operators import serving


def serving_report(log: DataFrame, step_seconds: int = 60) -> dict[str, DataFrame]:
    """All views of a serving log ``(ts, tier, duration_ms, error, load)``."""
    return {
        "tiers": serving.tier_shares(log),
        "latency": serving.latency_report(log),
        "latency_by_tier": serving.latency_report(log, ["tier"]),
        "histogram": serving.histogram(log, by=["tier"]),
        "rate": serving.rate(log),
        "targets": serving.slo_report(log),
        "tier_targets": serving.slo_report(log, serving.TIER_TARGETS),
        "alerts": serving.alerts(serving.metric_series(log, step_seconds), step_seconds=step_seconds),
    }
