"""Score columns: recency, frequency, retention, their blends, and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K


def hours_between(earlier: Column, later: Column) -> Column:
    """Hours from one timestamp to another, as a double; independent of the session's time zone."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3.6e9)


def recency(hours: Column) -> Column:
    """Banded recency of an age in hours; a null age is the oldest."""
    out = F.when(hours.isNull(), K.OLDEST_RECENCY)
    for most, score in K.RECENCY_BANDS:
        out = out.when(hours <= most, score)
    return out.otherwise(K.OLDEST_RECENCY)


def frequency(count: Column) -> Column:
    """Logarithmic access frequency, at most 1."""
    return F.least(F.lit(1.0), F.log2(F.greatest(F.lit(1), F.coalesce(count, F.lit(0)))) / 10)


def decay_hours(kind: Column) -> Column:
    """Decay scale of a type; null for types that never decay."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, hours in K.DECAY_HOURS.items():
        out = out.when(kind == name, F.lit(hours).cast("double"))
    return out.otherwise(float(K.DEFAULT_DECAY_HOURS))


def retention(kind: Column, locked: Column, hours: Column, stability: Column, accesses: Column, emotion: Column, idle_rate: float = 0.1) -> Column:
    """Share of a memory that is left: exp(-dilated hours / (stability * scale)), with a floor for much used nodes.

    Locked nodes, types that never decay and nodes never accessed keep 1; strong emotion lifts the rest.
    """
    scale = decay_hours(kind)
    left = F.when(locked | scale.isNull() | hours.isNull(), 1.0).otherwise(F.exp(-(hours * idle_rate) / (stability * scale)))
    left = F.when((F.coalesce(accesses, F.lit(0)) >= 5) & (left < 0.3), 0.3).otherwise(left)
    return F.when(emotion > 0.5, F.least(F.lit(1.0), left * (1 + emotion * 0.5))).otherwise(left)


def combined(relevance: Column, recent: Column, frequent: Column, emotion: Column, locked: Column) -> Column:
    """Blend of relevance, recency, frequency and emotion, with weights of its own for locked nodes."""
    feeling = F.least(F.lit(1.0), 0.3 + F.coalesce(emotion, F.lit(0.0)) * 0.7)
    return F.when(locked, relevance * 0.5 + recent * 0.2 + frequent * 0.05 + feeling * 0.25).otherwise(relevance * 0.35 + recent * 0.30 + frequent * 0.10 + feeling * 0.25)


def confidence_multiplier(confidence: Column) -> Column:
    """1 where unknown, else from 0.7 at confidence 0.1 up to 1.05 at 1."""
    return F.when(confidence.isNull(), 1.0).otherwise(F.least(F.lit(1.05), F.greatest(F.lit(0.7), 0.7 + (confidence - 0.1) * 0.35 / 0.9)))


def hub_damping(degree: Column, threshold: int = 40) -> Column:
    """1 up to the threshold, then in inverse proportion to the degree."""
    return F.when(degree > threshold, F.lit(float(threshold)) / degree).otherwise(1.0)


def blend(semantic: Column, keyword: Column) -> Column:
    """0.9 semantic and 0.1 keyword; a candidate of one path alone keeps that part."""
    return F.when(semantic.isNotNull() & keyword.isNotNull(), 0.9 * semantic + 0.1 * keyword).when(semantic.isNotNull(), semantic).otherwise(0.1 * keyword)


def nudge(confidence: Column, precision: Column) -> Column:
    """Confidence moved a twentieth of the way to the measured precision, within 0.1 to 1."""
    c = F.coalesce(confidence, F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), c + (precision - c) * 0.05))
