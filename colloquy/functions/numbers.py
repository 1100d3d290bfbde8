"""Signal arithmetic, in single precision where the score is."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much a message counts by its role, and the weights of the score.
ROLE_WEIGHTS = {"assistant": 1.0, "user": 0.8, "tool": 0.5, "system": 0.3}
HITS_WEIGHT, RECENCY_WEIGHT, TYPE_WEIGHT = 0.4, 0.3, 0.3
MOST_HITS = 10
DECAY_DAYS = 365.0
_DAY_MICROS = 86_400_000_000


def float_lit(x: float) -> Column:
    return F.lit(x).cast("float")


def type_weight(role: Column) -> Column:
    out = F.when(F.lit(False), float_lit(0))
    for name, weight in ROLE_WEIGHTS.items():
        out = out.when(role == name, float_lit(weight))
    return out


def age_days(created_at: Column, now: datetime) -> Column:
    """Whole periods of 24 hours, never negative."""
    micros = F.unix_micros(F.lit(now)) - F.unix_micros(created_at)
    return F.greatest(F.floor(micros / F.lit(_DAY_MICROS)), F.lit(0).cast("bigint"))


def recency(created_at: Column, now: datetime) -> Column:
    """exp(-days / 365) as a float; 1 for dates to come."""
    return F.greatest(F.least(F.exp(-age_days(created_at, now).cast("double") / DECAY_DAYS), F.lit(1.0)), F.lit(0.0)).cast("float")


def hits_norm(hits: Column) -> Column:
    return (F.least(hits, F.lit(MOST_HITS).cast("bigint")).cast("float") / float_lit(MOST_HITS)).cast("float")


def signal_score(hits: Column, created_at: Column, role: Column, now: datetime) -> Column:
    """Weighted sum of repetition, recency and role, left to right in floats."""
    first = (float_lit(HITS_WEIGHT) * hits_norm(hits)).cast("float")
    second = (float_lit(RECENCY_WEIGHT) * recency(created_at, now)).cast("float")
    third = (float_lit(TYPE_WEIGHT) * type_weight(role)).cast("float")
    return ((first + second).cast("float") + third).cast("float")
