"""Scalar business rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The event types, request limits and load steps of the platform.
EVENT_TYPES = ("click", "view", "purchase", "search", "add_to_cart", "remove_from_cart")
DEFAULT_LIMIT = 20
MAX_LIMIT = 100
LOAD_STEPS = ((3.0, "emergency"), (2.0, "critical"), (1.5, "warning"))
LEVELS = ("normal", "warning", "critical", "emergency")
#: First level at which a tier is switched off.
TIER_BLOCKED_FROM = {"tier3": "warning", "tier2": "critical", "tier1": "emergency"}


@dataclass(frozen=True)
class Weights:
    """Session re-rank weights."""

    base: float = 1.0
    clicked: float = -0.5
    viewed: float = -0.2


def is_click(event_type: Column) -> Column:
    return event_type == "click"


def in_stock(flag: Column, quantity: Column) -> Column:
    """A quantity of zero overrides the flag."""
    return flag & (quantity > 0)


def effective_limit(limit: Column) -> Column:
    """Requested limit as text -> usable limit."""
    is_number = limit.rlike("^[+-]?[0-9]+$")
    asked = F.when(is_number, limit.try_cast("bigint"))
    valid = F.when(asked > 0, asked).otherwise(F.lit(DEFAULT_LIMIT))
    return F.least(valid, F.lit(MAX_LIMIT)).cast("int")


def load_level(ratio: Column) -> Column:
    """Load ratio -> degradation level; no report counts as normal."""
    level = F.lit("normal")
    for bound, name in reversed(LOAD_STEPS):
        level = F.when(ratio >= bound, F.lit(name)).otherwise(level)
    return level


def tier_allowed(level: Column, tier: str | Column) -> Column:
    """Whether a tier may answer at a level; unknown tiers always may."""

    def below(name: str) -> Column:
        return level.isin(*LEVELS[: LEVELS.index(TIER_BLOCKED_FROM[name])])

    if isinstance(tier, str):
        return below(tier) if tier in TIER_BLOCKED_FROM else F.lit(True)
    allowed = F.lit(True)
    for name in TIER_BLOCKED_FROM:
        allowed = F.when(tier == name, below(name)).otherwise(allowed)
    return allowed


def adjusted_score(score: Column, clicked: Column, viewed: Column, weights: Weights = Weights()) -> Column:
    """Session penalties on a score; both may apply."""
    return (
        score * F.lit(weights.base)
        + F.when(clicked, F.lit(weights.clicked)).otherwise(F.lit(0.0))
        + F.when(viewed, F.lit(weights.viewed)).otherwise(F.lit(0.0))
    )


def age_seconds(as_of: Column, ts: Column) -> Column:
    """Whole seconds between two instants."""
    return F.unix_seconds(as_of) - F.unix_seconds(ts)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts)
