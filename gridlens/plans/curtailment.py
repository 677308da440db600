"""Matching planned partial curtailments to the daily maximum offer of a bid id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions.exprs import finite
from gridlens.operators.intervals import tolerance_join
from gridlens.operators.scoring import ranked, resolve, score_curtailments
from gridlens.sources.files import staged
from gridlens.sources.schemas import CURT, KIND, MW, NAME, OUT_START, PMAX, RES, SELF, SEQ, STARTTIME


@dataclass
class CurtailmentResult:
    final_matches: DataFrame
    match_detail: DataFrame
    scores: DataFrame
    top_candidates: DataFrame
    raw_matches: DataFrame
    planned_partial: DataFrame


def planned_partial(outages: DataFrame) -> DataFrame:
    """Planned events that leave a unit some capacity, once each; the start's date stands for the event."""
    p, c = F.col(f"`{PMAX}`"), F.col(f"`{CURT}`")
    df = outages.where((F.col(f"`{KIND}`") == "PLANNED") & (p > 0) & (c < p))
    return df.select(RES, NAME, F.to_date(F.col(f"`{OUT_START}`")).alias("curtailment_date"), PMAX, CURT, (p - c).alias("expected_available_mw")).distinct()


def pmax_lookup(planned: DataFrame, id_attrs: DataFrame, pmax_tolerance: float = 0.10) -> DataFrame:
    """(resource, id) pairs of fitting size. A resource with two capacities that both fit an id has the pair twice."""
    sizes = planned.select(F.col(f"`{RES}`"), F.col(f"`{PMAX}`")).distinct()
    return tolerance_join(sizes, PMAX, id_attrs.select(SEQ, "max_mw"), "max_mw", pmax_tolerance).select(F.col(f"`{RES}`"), SEQ)


def daily_max_mw(bids: DataFrame) -> DataFrame:
    """The largest offer or self-schedule of each id and date; days with neither are absent."""
    offer = F.greatest(finite(F.col(MW)), finite(F.col(SELF)))
    return bids.groupBy(SEQ, F.to_date(STARTTIME).alias("date")).agg(F.max(offer).alias("daily_max_mw")).where("daily_max_mw IS NOT NULL")


def raw_matches(planned: DataFrame, id_attrs: DataFrame, bids: DataFrame, tolerance: float = 0.05, pmax_tolerance: float = 0.10, pairs: DataFrame | None = None) -> DataFrame:
    """Events whose remaining capacity a fitting id's daily maximum meets within the tolerance, once for each of the resource's capacities that fits.

    Bids of ids that fit no event are dropped before the daily maxima are taken. An event carries its resource's capacities and a maximum
    its id's size, so the task that finds them near each other also tells whether they fit: near pairs that don't are never dealt.
    pairs: (resource, id) pairs to which the result is confined.
    """
    wanted = (pairs if pairs is not None else pmax_lookup(planned, id_attrs, pmax_tolerance)).select(SEQ).distinct()
    daily = daily_max_mw(bids.select(SEQ, STARTTIME, MW, SELF).join(wanted, SEQ, "left_semi")).withColumnRenamed("date", "curtailment_date").join(id_attrs.select(SEQ, F.col("max_mw").alias("_max")), SEQ)
    sizes = planned.groupBy(RES).agg(F.collect_set(PMAX).alias("_sizes"))
    events = planned if pairs is None else planned.join(pairs.select(RES).distinct(), RES, "left_semi")
    near = tolerance_join(events.join(sizes, RES), "expected_available_mw", daily, "daily_max_mw", tolerance, ["curtailment_date"])
    fit = F.size(F.filter("_sizes", lambda s: F.abs(F.col("_max") - s) / s <= pmax_tolerance))
    near = near.withColumn("_fit", fit).where("_fit > 0").withColumn("_fit", F.explode(F.sequence(F.lit(1), "_fit")))
    near = near.select(RES, NAME, "curtailment_date", PMAX, CURT, "expected_available_mw", SEQ, "daily_max_mw")
    return near if pairs is None else near.join(pairs.select(RES, SEQ).distinct(), [RES, SEQ], "left_semi")


def match(
    bids: DataFrame, outages: DataFrame, id_attrs: DataFrame, tolerance: float = 0.05, pmax_tolerance: float = 0.10, min_matches: int = 2, resolve_collisions: bool = True, top_n: int = 5, stage: bool = False,
) -> CurtailmentResult:
    """stage: write scores and planned events once, for callers that use several of the results."""
    planned = staged(planned_partial(outages)) if stage else planned_partial(outages)
    raw = raw_matches(planned, id_attrs, bids, tolerance, pmax_tolerance)
    scores = staged(score_curtailments(raw)) if stage else score_curtailments(raw)
    best = ranked(scores.where(F.col("n_matches") >= min_matches), RES, [F.col(SEQ), F.col(f"`{NAME}`")], max(top_n, 1))
    sizes = planned.groupBy(RES).agg(F.max(F.col(f"`{PMAX}`")).alias(PMAX))
    ids = id_attrs.select(SEQ, F.col("max_mw").alias("seq_max_mw"))
    full = lambda df: df.join(sizes, RES, "left").join(ids, SEQ, "left")
    winners = best.where("rank = 1").drop("rank")
    final = full(resolve(winners, [F.col(f"`{RES}`"), F.col(f"`{NAME}`")]) if resolve_collisions else winners)
    named = [RES, NAME, PMAX, SEQ, "seq_max_mw"]
    final = final.select(*named, "n_matches", "mean_pct_err", "score", "confidence").orderBy(F.desc("confidence"), F.desc("score"), RES)
    # the winners are few: theirs are matched again by themselves, so that all raw matches needn't be dealt to them
    matched = raw_matches(planned, id_attrs, bids, tolerance, pmax_tolerance, final.select(RES, SEQ))
    detail = matched.withColumn("mw_error", F.col("daily_max_mw") - F.col("expected_available_mw")).withColumn("pct_error", F.try_divide("mw_error", "expected_available_mw"))
    top = full(best.where(F.col("rank") <= top_n)).select(*named, "rank", "n_matches", "mean_pct_err", "score", "confidence")
    return CurtailmentResult(final, detail.orderBy(RES, "curtailment_date"), scores, top, raw, planned)
