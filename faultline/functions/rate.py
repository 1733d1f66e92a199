"""Exponentially decayed rates as plain sums, and what views ask of them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(instant: Column) -> Column:
    return F.unix_micros(instant) / F.lit(1e6)


def decay(elapsed: Column, half_life: float) -> Column:
    """Two to the minus elapsed half-lives; one for no or negative time."""
    return F.when(elapsed <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -elapsed / F.lit(float(half_life))))


def rate(at: Column, now: Column, half_life: float) -> Column:
    """Aggregate: the rate at ``now`` of events at the (clamped) instants ``at``.  Each event is an impulse of
    ln 2 / half-life that halves every half-life, so the recurrence is a sum and merges are additions."""
    return F.sum(decay(seconds(now) - seconds(at), half_life)) * F.lit(math.log(2) / half_life)


def ratio(fast: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, fast / baseline).when(fast > 0, F.lit(float("inf"))).otherwise(0.0)


def rounded(x: Column) -> Column:
    """Half away from zero to three places; what is not finite becomes zero."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(F.round(x, 3))


def age(first: Column, now: Column) -> Column:
    return F.greatest(seconds(now) - seconds(first), F.lit(0.0))


def is_new(first: Column, now: Column, new_age: float) -> Column:
    return age(first, now) <= new_age


def is_increasing(first: Column, now: Column, fast: Column, baseline: Column, min_age: float, min_ratio: float, min_rate: float) -> Column:
    return (age(first, now) >= min_age) & (fast >= F.lit(min_ratio) * baseline) & (fast >= min_rate)
