"""A small, self-consistent sample of all tables around the best matches, for examples and tests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.sources import schemas as S


@dataclass
class Sample:
    final_matches: DataFrame
    match_detail: DataFrame
    id_attrs: DataFrame
    outages: DataFrame
    curtailment_dam_data: DataFrame
    dam_plot_data: DataFrame
    rtm_outage_lookup: DataFrame
    rtm_data: DataFrame


def build_sample(final: DataFrame, detail: DataFrame, bids: DataFrame, rtm: DataFrame, outages: DataFrame, id_attrs: DataFrame, resources: int = 20, outages_each: int = 2, plot_rows: int = 100) -> Sample:
    """The `resources` matches with most events, and of every table only what belongs to them.

    The plotted day is the one whose number of points is nearest to plot_rows. Outage times come as text.
    """
    best = final.orderBy(F.desc("n_matches"), F.desc("confidence"), S.RES).limit(resources)
    names = best.select(F.col(f"`{S.RES}`"))
    ids = best.select(S.SEQ).distinct()
    detail = detail.join(names, S.RES, "left_semi")
    start, stop = F.col(f"`{S.OUT_START}`"), F.col(f"`{S.OUT_STOP}`")
    p, c = F.col(f"`{S.PMAX}`"), F.col(f"`{S.CURT}`")
    events = detail.select(S.RES, "curtailment_date", "expected_available_mw").distinct()
    partial = (
        outages.withColumn("curtailment_date", F.to_date(start)).withColumn("expected_available_mw", p - c)
        .join(events, [S.RES, "curtailment_date", "expected_available_mw"], "left_semi")
        .where((F.col(f"`{S.KIND}`") == "PLANNED") & (p > 0) & (c < p)).drop("curtailment_date", "expected_available_mw")
    )
    w = Window.partitionBy(F.col(f"`{S.RES}`")).orderBy(start, stop, F.col(f"`{S.NAME}`"), p, c)
    down = outages.join(names, S.RES, "left_semi").where((p > 0) & (c >= p) & start.isNotNull() & stop.isNotNull())
    down = down.groupBy(*[F.col(f"`{k}`") for k in S.OUTAGES if k != S.KIND]).agg(F.min(F.col(f"`{S.KIND}`")).alias(S.KIND)).select(*[F.col(f"`{k}`") for k in S.OUTAGES]).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= outages_each).drop("_k")
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    report = partial.unionByName(down).withColumn(S.OUT_START, text(start)).withColumn(S.OUT_STOP, text(stop))

    dam = bids.where(F.col(S.PRODUCT) == "EN").join(ids, S.SEQ, "left_semi").withColumn("day", F.to_date(S.STARTTIME))
    days = detail.select(S.SEQ, F.col("curtailment_date").alias("day")).distinct()
    matched = dam.join(days, [S.SEQ, "day"], "left_semi").select(S.SEQ, F.col("day").alias(S.STARTTIME), S.MW, S.SELF, S.PRICE)
    n = dam.where(F.col(S.MW).isNotNull() & F.col(S.PRICE).isNotNull()).groupBy(S.SEQ, "day").agg(F.count("*").alias("n"))
    choice = n.where("n >= 2").orderBy(F.abs(F.col("n") - plot_rows), S.SEQ, "day").limit(1)
    if not choice.count():
        choice = n.orderBy(F.desc("n"), S.SEQ, "day").limit(1)
    plotted = dam.join(choice.select(S.SEQ, "day"), [S.SEQ, "day"], "left_semi").select(S.SEQ, S.STARTTIME, S.MW, S.PRICE, S.SELF)

    lookup = down.join(best.select(S.RES, S.SEQ), S.RES).select(
        F.col(f"`{S.RES}`").alias("generator"), S.SEQ, p.alias("pmax_mw"), start.alias("outage_start"), stop.alias("outage_stop"),
        F.date_sub(F.to_date(start), 1).alias("window_start"), F.date_add(F.to_date(stop), 1).alias("window_stop"),
    )
    day = F.to_date(F.coalesce(S.BID_START, S.RUN_START))
    real = rtm.where(F.col(S.PRODUCT) == "EN").select(*S.RTM).withColumn("_day", day).join(lookup.select(S.SEQ, "window_start", "window_stop"), S.SEQ)
    real = real.where(F.col("_day").between(F.col("window_start"), F.col("window_stop"))).select(*S.RTM).distinct()
    return Sample(best, detail, id_attrs.join(ids, S.SEQ, "left_semi"), report, matched, plotted, lookup, real)
