"""Forgetting curve, states, composite scores and ranks: column formulas with an explicit clock."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlode.functions.columns import clamp, days_until

#: Default stability in days by memory type, and weights of the search modes
#: (semantic, recency, decay, importance, confidence).
STABILITY = {"IDENTITY": 365, "PREFERENCE": 270, "RELATIONSHIP": 270, "EVENT": 120, "ACTIVITY": 90, "PLAN": 60, "CONTEXT": 21, "EPHEMERAL": 3}
MODES = {
    "balanced": (0.35, 0.20, 0.20, 0.20, 0.05),
    "recent": (0.30, 0.50, 0.10, 0.07, 0.03),
    "important": (0.40, 0.10, 0.10, 0.35, 0.05),
    "historical": (0.50, 0.05, 0.25, 0.15, 0.05),
    "comprehensive": (0.45, 0.15, 0.15, 0.20, 0.05),
}


def default_stability(memory_type: Column) -> Column:
    out = F.lit(90)
    for name, days in STABILITY.items():
        out = F.when(F.upper(memory_type) == name, days).otherwise(out)
    return out.cast("double")


def decay_factor(now: datetime, last: str = "last_accessed_at", stability: str = "stability", accesses: str = "access_count") -> Column:
    """exp(-days / (stability (1 + ln(1 + accesses) / 2))); stability of 0 or less, or null, counts as 60 days; never accessed: no decay."""
    s = F.when(F.col(stability) > 0, F.col(stability)).otherwise(60.0)
    days = F.coalesce(days_until(last, now), F.lit(0.0))
    return F.exp(-days / (s * (1 + 0.5 * F.log1p(F.greatest(F.coalesce(F.col(accesses), F.lit(0)), F.lit(0)).cast("double")))))


def decay_state(factor: Column) -> Column:
    return F.when(factor >= 0.3, "active").when(factor >= 0.1, "stale").when(factor >= 0.01, "archived").otherwise("deleted")


def burst_boost(now: datetime, last: str = "last_accessed_at", accesses: str = "access_count") -> Column:
    days = days_until(last, now)
    return F.when((F.col(accesses) < 3) | days.isNull() | (days > 1), 0.0).otherwise(F.least(F.lit(0.3), 0.015 * F.col(accesses)))


def grown_stability(now: datetime, last: str = "last_accessed_at", stability: str = "stability", accesses: str = "access_count") -> Column:
    """Stability after one more access: the longer the gap, the larger the growth."""
    days = F.coalesce(days_until(last, now), F.lit(0.0))
    base = F.when(days < 1, 1.10).when(days < 7, 1.20).when(days < 30, 1.35).otherwise(1.60)
    s = F.when(F.col(stability) > 0, F.col(stability)).otherwise(60.0)
    return s * base * (1 + F.least(F.lit(0.15), 0.025 * F.log1p(F.col(accesses).cast("double"))))


def half_life(stability: Column) -> Column:
    return stability * F.log(F.lit(2.0))


def days_to(stability: Column, threshold: float) -> Column:
    """Days until the factor falls to ``threshold``; 0 outside (0, 1)."""
    return -stability * F.log(F.lit(threshold)) if 0 < threshold < 1 else F.lit(0.0)


def recency(now: datetime, created: str = "created_at", last: str = "last_accessed_at") -> Column:
    return 1 / (1 + F.log1p(days_until(F.greatest(F.col(created), F.coalesce(F.col(last), F.col(created))), now)))


def composite(similarity: Column, now: datetime, mode: str = "balanced") -> Column:
    a, b, c, d, e = MODES[mode]
    return a * similarity + b * recency(now) + c * decay_factor(now) + d * F.coalesce("importance", F.lit(0.0)) + e * F.coalesce("confidence", F.lit(0.0))


def eviction_rank(now: datetime) -> Column:
    """The smaller, the sooner a memory leaves the index."""
    idle = days_until("last_accessed_at", now) * 24
    boost = F.when(idle < 24, 2.0).when(idle < 168, 1.5).when(idle < 720, 1.2).otherwise(1.0)
    age = days_until("created_at", now)
    fade = F.when(age.isNull(), 0.8).when(age <= 30, 1.0).otherwise(1 / (1 + F.log(F.greatest(age, F.lit(30.0)) / 30)))
    return F.greatest(F.coalesce("importance", F.lit(0.0)), F.lit(0.01)) * (1 + F.log1p(F.coalesce("access_count", F.lit(0)).cast("double"))) * boost * fade


def retrieval_score(similarity: Column, now: datetime) -> Column:
    """Similarity, importance and a 24-hour recency window, damped by decay; fresh rows get up to a tenth more."""
    hours = days_until("created_at", now) * 24
    fresh = F.when(hours <= 24, 1 - hours / 24).otherwise(0.0)
    score = (0.5 * similarity + 0.3 * F.coalesce("importance", F.lit(0.0)) + 0.2 * fresh) * (0.5 + 0.5 * decay_factor(now))
    return F.when(fresh > 0.5, score * (1 + 0.2 * (fresh - 0.5))).otherwise(score)


def blended(judged: Column, score: Column) -> Column:
    """An outside judgement and the own score."""
    return 0.6 * judged + 0.4 * score


def merged_importance(first: Column, second: Column) -> Column:
    """The mean if the second is larger, else the first, within [0, 1]."""
    return clamp(F.when(second > first, (first + second) / 2).otherwise(first), 0.0, 1.0)


def deadline_proximity(expires: Column, now: datetime) -> Column:
    """1 / hours left, hours counting as half an hour at least; a tenth of an hour once overdue."""
    hours = (F.unix_micros(expires.cast("timestamp")) - F.lit(int(now.replace(tzinfo=timezone.utc).timestamp() * 1e6))) / 3_600_000_000.0
    return 1 / F.when(hours <= 0, 0.1).otherwise(F.greatest(hours, F.lit(0.5)))
