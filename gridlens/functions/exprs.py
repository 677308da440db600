"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite (both would win every max)."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def rel_err(a: Column, b: Column) -> Column:
    """|a - b| / b; null where b is 0."""
    return F.try_divide(F.abs(a - b), b)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a clock time, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def minutes_between(a: Column, b: Column) -> Column:
    """Fractional minutes from b to a."""
    return (micros(a) - micros(b)) / 60e6


def plus_minutes(ts: Column, minutes: float) -> Column:
    return ts + F.make_dt_interval(mins=F.lit(int(minutes)), secs=F.lit(round((minutes - int(minutes)) * 60, 6)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def confidence(score: Column, runner_up: Column) -> Column:
    """How far a winner stands out: 1 if alone, 0 if its score isn't positive, else 1 - runner_up / score in 0..1."""
    return F.when(runner_up.isNull(), 1.0).when(score <= 0, 0.0).otherwise(clamp01(1 - F.try_divide(runner_up, score)))


def period(start: Column, end: Column, target_start: Column, target_end: Column) -> Column:
    """Where an activity span lies against a target's; null if it can't be told."""
    return F.when(end < target_start, "Before").when(start > target_end, "After").when((start <= target_end) & (end >= target_start), "During")
