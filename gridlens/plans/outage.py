"""Matching full outages to gaps in real-time bidding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.exprs import finite, minutes_between, plus_minutes
from gridlens.operators.intervals import OPEN_END, bid_gaps, energy_bids, interval_join, merge_outages
from gridlens.operators.scoring import key, ranked, resolve, score_outages
from gridlens.sources.files import staged
from gridlens.sources.schemas import MW, SEQ


@dataclass
class OutageResult:
    final_matches: DataFrame
    match_detail: DataFrame
    scores: DataFrame
    top_candidates: DataFrame
    raw_matches: DataFrame
    outages: DataFrame


def seq_max_mw(rtm: DataFrame) -> DataFrame:
    return energy_bids(rtm).groupBy(SEQ).agg(F.max(finite(F.col(MW))).alias("max_mw"))


def raw_matches(outages: DataFrame, rtm: DataFrame, edge_minutes: float = 5) -> DataFrame:
    """Merged outages that begin within edge_minutes of where an id stops bidding, and end before it bids again (less the same margin)."""
    gaps = bid_gaps(rtm, edge_minutes)
    width = max(2 * edge_minutes, 60)
    pairs = interval_join(outages, "outage_start", gaps, "gap_start_min", "gap_start_max", width)
    end = plus_minutes(F.coalesce("outage_stop", F.lit(OPEN_END).cast("timestamp_ntz")), -edge_minutes)
    pairs = pairs.where(F.col("next_bid_start_cmp") >= end).join(seq_max_mw(rtm), SEQ, "left")
    return pairs.select(
        "generator", "outage_start", "outage_stop", "pmax_mw", SEQ, "last_bid_stop", "next_bid_start",
        minutes_between(F.col("last_bid_stop"), F.col("outage_start")).alias("stop_offset"),
        minutes_between(F.col("next_bid_start"), F.col("outage_stop")).alias("restart_offset"), "max_mw",
    )


def match(rtm: DataFrame, outages: DataFrame, generators: list[str] | None = None, edge_minutes: float = 5, min_matches: int = 1, resolve_collisions: bool = True, top_n: int = 5, stage: bool = False) -> OutageResult:
    """stage: write scores and merged outages once, for callers that use several of the results."""
    clean = staged(merge_outages(outages, generators)) if stage else merge_outages(outages, generators)
    raw = raw_matches(clean, rtm, edge_minutes)
    scores = staged(score_outages(raw)) if stage else score_outages(raw)
    enough = scores.where(F.col("n_matches") >= min_matches)
    ties = [key("mean_abs_stop_offset").asc(), F.col(SEQ)]
    best = ranked(enough, "generator", ties, max(top_n, 1))
    winners = best.where("rank = 1").drop("rank")
    final = resolve(winners, [key("mean_abs_stop_offset").asc(), F.col("generator")]) if resolve_collisions else winners
    final = final.orderBy(F.desc("confidence"), F.desc("score"), "generator")
    detail = raw.join(final.select("generator", SEQ), ["generator", SEQ], "left_semi").orderBy("generator", "outage_start", SEQ)
    top = best.where(F.col("rank") <= top_n).drop("rank", "confidence")
    return OutageResult(final, detail, scores, top, raw, clean)
