"""Intervals: merging, gaps, and joins without an equality key.

Spark has no plan of its own for range predicates but nested loops. Both joins here deal the points
and the intervals to buckets, join on the bucket, and then apply the exact predicate. A point is in
one bucket only, so no pair comes twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.exprs import micros, plus_minutes
from gridlens.sources.schemas import BID_START, BID_STOP, CURT, OUT_START, OUT_STOP, PMAX, PRODUCT, RES, RUN_START, RUN_STOP, SEQ

OPEN_END = "2999-12-31 00:00:00"


def full_outages(outages: DataFrame, generators: list[str] | None = None) -> DataFrame:
    """Rows where the whole unit is down. generators: only these; None: all; empty: none."""
    df = outages.where((F.col(f"`{PMAX}`") > 0) & (F.col(f"`{CURT}`") >= F.col(f"`{PMAX}`")))
    if generators is not None:
        df = df.where(F.col(f"`{RES}`").isin(generators) if generators else F.lit(False))
    return df.select(F.col(f"`{RES}`").alias("generator"), F.col(f"`{OUT_START}`").alias("outage_start"), F.col(f"`{OUT_STOP}`").alias("outage_stop"), F.col(f"`{PMAX}`").alias("pmax_mw"))


def merge_outages(outages: DataFrame, generators: list[str] | None = None) -> DataFrame:
    """generator, outage_start, outage_stop, pmax_mw: overlapping or touching full outages as one.

    An outage without an end reaches to the next one's start, and so always joins it; the merged end is the
    largest known one, unknown only if none is known.
    """
    one = full_outages(outages, generators).groupBy("generator", "outage_start").agg(F.max("outage_stop").alias("outage_stop"), F.max("pmax_mw").alias("pmax_mw"))
    w = Window.partitionBy("generator").orderBy(F.asc_nulls_last("outage_start"), F.asc_nulls_last("outage_stop"))
    reach = one.withColumn("reach", F.coalesce("outage_stop", F.lead("outage_start").over(w), "outage_start"))
    before = F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("outage_start") > before, F.lit(True)).cast("int")
    marked = reach.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy("generator", "island").agg(F.min("outage_start").alias("outage_start"), F.max("outage_stop").alias("outage_stop"), F.max("pmax_mw").alias("pmax_mw"))
    return islands.drop("island")


def energy_bids(rtm: DataFrame) -> DataFrame:
    return rtm.where((F.col(PRODUCT) == "EN") & F.col(SEQ).isNotNull())


def bid_gaps(rtm: DataFrame, edge_minutes: float = 5) -> DataFrame:
    """Where an id's bid ends and the next one, by start, begins later; the last bid's gap is open.

    Only the next row counts, so a bid inside a longer one makes a gap of its own.
    """
    spans = energy_bids(rtm).select(SEQ, F.coalesce(BID_START, RUN_START).alias("bid_start"), F.coalesce(BID_STOP, RUN_STOP).alias("last_bid_stop")).where("bid_start IS NOT NULL AND last_bid_stop IS NOT NULL").distinct()
    w = Window.partitionBy(SEQ).orderBy("bid_start", "last_bid_stop")
    gaps = spans.withColumn("next_bid_start", F.lead("bid_start").over(w)).where("next_bid_start IS NULL OR next_bid_start > last_bid_stop")
    stop = F.col("last_bid_stop")
    return gaps.select(
        SEQ, "last_bid_stop", "next_bid_start", F.coalesce("next_bid_start", F.lit(OPEN_END).cast("timestamp_ntz")).alias("next_bid_start_cmp"),
        plus_minutes(stop, -edge_minutes).alias("gap_start_min"), plus_minutes(stop, edge_minutes).alias("gap_start_max"),
    )


def interval_join(points: DataFrame, point: str, spans: DataFrame, lo: str, hi: str, width_minutes: float) -> DataFrame:
    """All pairs with lo <= point <= hi; names must not clash. Spans no longer than width_minutes go to two buckets at most."""
    size = max(1, int(width_minutes * 60_000_000))
    bucket = lambda c: F.floor(micros(F.col(c)) / size).cast("long")
    left = points.withColumn("_bucket", bucket(point))
    right = spans.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))).withColumn("_bucket", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return left.join(right, "_bucket").where(F.col(point).between(F.col(lo), F.col(hi))).drop("_bucket")


def tolerance_join(left: DataFrame, target: str, right: DataFrame, value: str, tolerance: float, on: list[str] | None = None) -> DataFrame:
    """All pairs, equal in `on`, with |value - target| / target <= tolerance, for positive targets; other names must not clash.

    Values go to buckets of one tolerance's width on a logarithmic scale, so a target looks into three or four
    of them. From a tolerance of 1 on, the range reaches 0 and nearly all pairs are wanted: a plain condition.
    """
    t, v = F.col(f"`{target}`"), F.col(f"`{value}`")
    near = F.abs(v - t) / t <= tolerance
    if tolerance >= 1:
        a = left.where(t > 0)
        return a.join(right, on).where(near) if on else a.join(right, near)
    width = math.log1p(max(tolerance, 1e-6))

    def at(c: Column, shift: float = 0.0) -> Column:
        return F.floor(F.log(c) / width + shift).cast("long")

    a = left.where(t > 0).withColumn("_bucket", F.explode(F.sequence(at(t * (1 - tolerance), -1e-6), at(t * (1 + tolerance), 1e-6))))
    b = right.where(v > 0).withColumn("_bucket", at(v))
    return a.join(b, [*(on or []), "_bucket"]).where(near).drop("_bucket")
